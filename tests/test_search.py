"""An index in files is built where the documents are read."""

from lorekeep.operators import search


def test_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"the end of the {'long ' * (i % 3)}day {i}") for i in range(60)], "doc_id long, text string").repartition(3)
    dealt, frame = [], type(docs)
    monkeypatch.setattr(frame, "repartition", lambda self, *a: dealt.append(a) or self)
    folder = f"file://{tmp_path}/index"
    search.build_index(docs, folder)
    assert not dealt
    of = lambda index: sorted(tuple(r) for r in search.bm25(index, 'long "of the"').collect())
    assert len(of(search.open_index(spark, folder))) == 40
    assert [(d, round(x, 9)) for d, x in of(search.open_index(spark, folder))] == [(d, round(x, 9)) for d, x in of(search.index_of(docs))]
