"""Personal data: base detectors by pattern, and bootstrapped contextual extraction. DataFrame and SQL functions only.

Base spans (e-mail, IP, card, phone) seed the bootstrap, and so do secrets: long tokens that mix letters and digits. Every
token with a digit or an at sign is an instance, and so is the beginning of a run of digits that its detector refused, as
far as it has the shape of accepted ones (a number that runs into the next one). The lexical patterns of an instance are
the word before it, the two words before it, the word after it (or the shape of a neighbour with digits), what it opens
with up to ":" or "=", and, of a run of digits, its shape. The links between patterns and instances form a bipartite graph
that is scored in rounds: a pattern's confidence in a kind is the belief in its distinct instances for that kind over
their number, shrunk by PRIOR; an instance that no seed knows is believed as far as its most confident pattern. Patterns
that reach CONFIDENCE with at least SUPPORT distinct instances add the instances that they introduce, where no base span
is, as spans of that kind.

A text is cut once by each detector into gaps and matches; positions are running sums over the matches of a document,
so work follows the number of matches. Texts without a digit or an at sign are not cut at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import materialize, read, small

KINDS = ("email", "ip", "card", "phone")
#: All kinds of spans by number, from one; the last has no base detector.
NAMES = (*KINDS, "secret")
#: The contract's patterns. A run is entered at its first character only (or where the last match ended), and repeated
#: groups give nothing back: the same matches, but linear in the text, and without recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
IP_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: A token that seeds the kind "secret": at least 32 signs with eight digits and four letters among them.
SECRET = r"^(?=(?:[^0-9]*+[0-9]){8})(?=(?:[^A-Za-z]*+[A-Za-z]){4})[A-Za-z0-9_+/=-]{32,}$"
SUPPORT, CONFIDENCE, PRIOR, ROUNDS = 5, 0.8, 1.0, 3
#: Digits that an added span of a kind has at least.
LEAST_DIGITS = {"ip": 4, "card": 12, "phone": 7}
_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.try_to_number(F.substring(back, i, F.lit(1)), F.lit("9")).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(d * 2 - 9 * (d > 4)) for d in range(10)]), F.try_to_number(F.substring(back, i, F.lit(1)), F.lit("9")).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", m.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"))
        .when(kind == "card", F.when((n >= 13) & (n <= 19), luhn(d)).otherwise(False))
        .when(kind == "phone", (n >= 9) & (n <= 15))
    )


_MATCH = "struct<kind:string,m:string,gap:bigint,tail:string,head:string>"


def _cut(text: Column, kind: str, pattern: str, guard: Column) -> Column:
    """The matches of pattern, each with the length of the gap before it and, for tokens, the words next to it: the last
    two of the gap before, the first of the gap behind."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind == "token":
        last_two = rf"^{_SPACE}*+({_WORD}++(?:{_SPACE}++{_WORD}++)?+)"
        tail = lambda g: F.lower(F.regexp_replace(F.reverse(F.regexp_extract(F.reverse(g), last_two, 1)), rf"{_SPACE}+", " "))
        head = lambda g: F.lower(F.regexp_extract(g, rf"^{_SPACE}*+({_WORD}++)", 1))
    else:
        tail = head = lambda g: F.lit("")
    rows = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).cast("long").alias("gap"), tail(g).alias("tail")))
    rows = F.zip_with(rows, F.slice(gaps, 2, F.size(found)), lambda x, g: F.struct(F.lit(kind).alias("kind"), x["m"].alias("m"), x["gap"].alias("gap"), x["tail"].alias("tail"), head(g).alias("head")))
    return F.when(guard, rows).otherwise(F.array().cast(f"array<{_MATCH}>"))


def scan(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text_hash, found): every row with all matches of all detectors, in one pass over the texts."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    some = text.rlike("[0-9@]")
    guards = {"email": some & F.contains(text, F.lit("@")), "ip": some & F.contains(text, F.lit(".")), "card": some, "phone": some & F.contains(text, F.lit("+")), "token": some}
    found = F.concat(*[_cut(text, k, p, guards[k]) for k, p in {**BASE, "token": TOKEN}.items()])
    return materialize(rows.select("rid", "doc_id", "text_hash", found.alias("found")), "pii-matches")


def positions(found: DataFrame) -> DataFrame:
    """(rid, kind, i, m, tail, head, s, e): matches with code-point positions, end exclusive."""
    rows = found.select("rid", F.posexplode("found").alias("i", "x")).select("rid", "i", "x.*")
    w = Window.partitionBy("rid", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("m")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("e", end).withColumn("s", F.col("e") - F.length("m")).drop("gap")


def _shape(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(text), "[0-9]", "9")


def _tokens(placed: DataFrame) -> DataFrame:
    """Tokens without outer punctuation, with their patterns and the kind of a base span that they touch."""
    t = placed.where("kind = 'token'")
    t = t.withColumn("core", F.regexp_extract("m", r"[A-Za-z0-9+(](?:.*[A-Za-z0-9)])?", 0)).where("length(core) > 0")
    t = t.withColumn("s", F.col("s") + F.instr("m", F.col("core")) - 1).withColumn("e", F.col("s") + F.length("core"))
    w = Window.partitionBy("rid").orderBy("i")
    word = F.substring_index("tail", " ", -1)
    before = F.when(word != "", word).when(F.lag("e").over(w).isNotNull(), _shape(F.lag("m").over(w)))
    behind = F.when(F.col("head") != "", F.col("head")).when(F.lead("e").over(w).isNotNull(), _shape(F.lead("m").over(w)))
    opens = F.regexp_extract(F.lower("m"), r"^([^0-9@:=]{2,}[:=])", 1)
    name = lambda kind, c, when: F.when(when, F.concat(F.lit(kind), c))
    patterns = F.array_compact(F.array(
        name("after ", before, before.isNotNull()), name("after two ", F.col("tail"), F.contains("tail", F.lit(" "))),
        name("before ", behind, behind.isNotNull()), name("opens ", opens, opens != ""),
    ))
    t = t.select("rid", "core", "s", "e", patterns.alias("patterns"))
    base = placed.where("kind <> 'token'").select("rid", "kind", "s", "e", "m")
    both = t.select("*", F.lit(None).cast("string").alias("kind")).unionByName(base, allowMissingColumns=True)
    order = Window.partitionBy("rid").orderBy("s", F.col("kind").asc_nulls_last(), "e")
    past = F.max(F.when(F.col("kind").isNotNull(), F.struct("e", "kind", "s", "m"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    next_ = F.first(F.when(F.col("kind").isNotNull(), F.struct("s", "kind", "m")), ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = both.withColumn("past", past).withColumn("next", next_).where("kind IS NULL")
    touched = F.when(F.col("past.e") > F.col("s"), F.col("past.kind")).when(F.col("next.s") < F.col("e"), F.col("next.kind"))
    # a token in which a base span begins stands for the whole span; one further inside it for itself
    whole = F.when((F.col("past.e") > F.col("s")) & (F.col("past.s") >= F.col("s")), F.col("past.m")).when(F.col("next.s") < F.col("e"), F.col("next.m"))
    both = both.select("rid", F.coalesce(whole, "core").alias("core"), "s", "e", "patterns", touched.alias("base"))
    return both.withColumn("seed", F.coalesce("base", F.when(F.col("core").rlike(SECRET), "secret")))


def _runs(placed: DataFrame, refused: DataFrame, support: int) -> DataFrame:
    """Runs of digits as instances of their shape: accepted ones, and the beginnings of refused ones that have the shape of
    at least `support` accepted ones, pass the kind's check, and don't cut a number."""
    runs = placed.where("kind IN ('card', 'phone')").select("rid", "kind", "s", "e", "m", _shape("m").alias("shape"))
    shapes = runs.groupBy("kind", "shape").agg(F.count_distinct("m").alias("n")).where(F.col("n") >= support)
    shapes = small(materialize(shapes.select("kind", "shape", F.substring("shape", 1, 6).alias("opening")), "pii-shapes"))
    cut = refused.select("rid", "kind", "s", "m", _shape("m").alias("full"), F.substring(_shape("m"), 1, 6).alias("opening")).join(shapes, ["kind", "opening"])
    n = F.length("shape")
    cut = cut.where(F.startswith("full", F.col("shape")) & (F.substring("full", n + 1, F.lit(1)) != "9"))
    cut = cut.select("rid", "kind", "s", (F.col("s") + n).alias("e"), F.substring("m", F.lit(1), n).alias("m"), "shape").where(_valid(F.col("kind"), F.col("m")))
    named = lambda rows, base: rows.select("rid", F.col("m").alias("core"), "s", "e", F.array(F.concat_ws(" ", F.lit("shape"), "kind", "shape")).alias("patterns"), base.cast("string").alias("base"), base.cast("string").alias("seed"))
    return named(runs, F.col("kind")).unionByName(named(cut, F.lit(None)))


def bootstrap(instances: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, prior: float = PRIOR) -> DataFrame:
    """(pattern, kind, score) of instances(core, seed, patterns): the patterns that reach the confidence, after scoring the
    pattern-instance graph in rounds. seed is the kind of a known instance, else null."""
    edges = materialize(instances.select("core", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "core").agg(F.max("seed").alias("seed")), "pii-edges")
    belief = edges.where("seed IS NOT NULL").groupBy("core").agg(F.max("seed").alias("kind")).withColumn("belief", F.lit(1.0))
    seeds = belief = materialize(belief, "pii-seeds")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    edges = materialize(edges.join(sizes, "pattern").select("pattern", "core", "n"), "pii-graph")
    good = None
    for _ in range(rounds):
        score = edges.join(belief, "core").groupBy("pattern", "kind").agg((F.sum("belief") / (F.max("n") + prior)).alias("score"))
        good = materialize(score.where(F.col("score") >= confidence), "pii-patterns")
        new = edges.join(good, "pattern").groupBy("core").agg(F.max(F.struct("score", "kind")).alias("b")).select("core", F.col("b.kind").alias("kind"), F.col("b.score").alias("belief"))
        belief = seeds.unionByName(new.join(seeds.select("core"), "core", "left_anti"))
    return good


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans (an array of kind number, s, e, added, by kind and start) and text_hash (xxhash64) of every row.

    Null text is empty. Repeated rows give a row each, null doc_ids stay null, documents without personal data have an
    empty array, an empty table gives an empty result, and columns other than doc_id and text are not read.
    """
    found = scan(docs)
    columns = ["rid", "kind", "i", "m", "tail", "head", "s", "e"]
    every = materialize(positions(found).select(columns), "pii-every")
    ok = F.coalesce(_valid(F.col("kind"), F.col("m")), F.lit(False))
    base = every.where("kind <> 'token'").where(ok)
    refused = every.where("kind IN ('card', 'phone')").where(~ok)
    placed = materialize(base.unionByName(every.where("kind = 'token'")), "pii-placed")
    instances = materialize(_tokens(placed).unionByName(_runs(placed, refused, SUPPORT)), "pii-instances")
    good = small(bootstrap(instances))
    added = instances.where("seed IS NULL").select("rid", "s", "e", F.length(_digits(F.col("core"))).alias("digits"), F.explode("patterns").alias("pattern")).join(good, "pattern")
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in LEAST_DIGITS.items()], F.lit(0))
    added = added.where(F.col("digits") >= least)
    added = added.groupBy("rid", "s", "e").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))
    added = added.unionByName(instances.where("base IS NULL AND seed IS NOT NULL").select("rid", "s", "e", F.col("seed").alias("kind")))
    w = Window.partitionBy("rid").orderBy("s", F.desc("e"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("reach", F.max("e").over(w)).where("reach IS NULL OR e > reach").drop("reach")  # what lies in another goes
    spans = placed.where("kind <> 'token'").select("rid", "kind", "s", "e", F.lit(False).alias("added")).unionByName(
        added.select("rid", "kind", "s", "e", F.lit(True).alias("added"))
    )
    number = F.array_position(F.array(*[F.lit(k) for k in NAMES]), F.col("kind")).cast("int")
    listed = spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(number.alias("kind"), "s", "e", "added"))).alias("spans"))
    none = F.array().cast("array<struct<kind:int,s:bigint,e:bigint,added:boolean>>")
    return found.select("rid", "doc_id", "text_hash").join(listed, "rid", "left").select("doc_id", F.coalesce("spans", none).alias("spans"), "text_hash")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, with spans of its four kinds; then n_added of these, n_secret and secret_spans, n_found of all."""
    rows = find(read(spark, sf_dir, "documents"))
    listed, secret = F.filter("spans", lambda x: x["kind"] <= len(KINDS)), F.filter("spans", lambda x: x["kind"] > len(KINDS))
    base = F.filter("spans", lambda x: ~x["added"])
    size = lambda c, name: F.size(c).cast("long").alias(name)
    of_kind = lambda k: F.filter(base, lambda x: x["kind"] == k)
    counts = [size(of_kind(k), f"n_{name}") for k, name in enumerate(KINDS, 1)]
    more = [size(F.filter(listed, lambda x: x["added"]), "n_added"), size(secret, "n_secret"), _joined(secret).alias("secret_spans"), size(F.col("spans"), "n_found")]
    return rows.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(listed).alias("spans"), *more)
