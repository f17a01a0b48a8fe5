"""The stage graph: what a change makes stale and what can be used again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

# Each stage with those it is made from.
STAGES: dict[str, tuple[str, ...]] = {
    "manifest": (),
    "decode": ("manifest",),
    "asr": ("decode",),
    "diarization": ("decode",),
    "attribution": ("asr", "diarization"),
    "exemplars": ("diarization",),
    "speaker_embeddings_resnet293": ("exemplars",),
    "speaker_embeddings_eres2net": ("exemplars",),
    "speaker_embeddings_wavlm": ("exemplars",),
    "voice_indexes": ("speaker_embeddings_resnet293", "speaker_embeddings_eres2net", "speaker_embeddings_wavlm"),
    "candidates": ("voice_indexes",),
    "identity_decisions": ("candidates",),
    "chunks": ("attribution",),
    "text_index": ("chunks",),
}


def downstream(changed: Sequence[str], graph: Mapping[str, Sequence[str]] = STAGES) -> set[str]:
    """changed and everything that is made from it, directly or not."""
    if unknown := set(changed) - set(graph):
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    stale, grew = set(changed), True
    while grew:
        more = {s for s, made_from in graph.items() if stale.intersection(made_from)} - stale
        stale |= more
        grew = bool(more)
    return stale


def reusable(available: Sequence[str], changed: Sequence[str], graph: Mapping[str, Sequence[str]] = STAGES) -> set[str]:
    return set(available) - downstream(changed, graph)
