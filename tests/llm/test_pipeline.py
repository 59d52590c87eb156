"""The pipeline on a small folder of tables: each stage takes effect."""

import random

from pyspark.sql import functions as F


def test_stages(llm, tmp_path):
    import corpus_pipeline as p

    r = random.Random(1)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    item = prose(30)
    good = [(i, prose(80)) for i in range(120)]
    bad = [(200 + i, "!! ".join(prose(80).upper().split())) for i in range(40)]
    copy = [(300, good[3][1]), (301, good[3][1] + " end")]
    rows = good + bad + copy + [(302, prose(20) + " " + item), (303, prose(70) + ' token = "0123456789abcdef"'), (304, None)]
    docs = llm.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = docs.where("doc_id < 300").select("doc_id", (F.col("doc_id") < 200).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    llm.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = docs
    left = []
    for _, stage in p.STAGES[:-1]:
        seen = stage(llm, seen, str(tmp_path))
        assert seen.columns == p.COLUMNS
        left.append({x.doc_id for x in seen.collect()})
    assert not any(200 <= i < 300 for i in left[0]) and {x for x, _ in good} <= left[0]
    assert left[0] - left[1] == {300, 301} and left[1] - left[2] == {302} and left[3] == left[2]
    row = seen.where("doc_id = 303").first()
    assert row.text.endswith(' [secret]"') and row.n_chars == len(row.text)
    out = p.run(llm, str(tmp_path))
    assert {x.doc_id for x in out.collect()} == left[3]


def test_null_and_shared_ids_lose_no_text(llm, tmp_path):
    """Near duplicates go by text, not by doc_id."""
    import corpus_pipeline as p
    from strandgraph.llm.near_dedup import near_duplicates

    r = random.Random(2)
    prose = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(1, a), (1, b), (1, b + " end"), (None, c), (None, c), (None, d), (2, d + " end"), (3, e), (3, e), (4, ""), (None, ""), (None, ""), (None, None), (5, b.upper())]
    docs = llm.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda x: (str(x[0]), str(x[1]))
    left = sorted(((x.doc_id, x.text) for x in p.near_duplicates(llm, docs, str(tmp_path)).collect()), key=key)
    one_b = next(t for i, t in left if i == 1 and t != a)
    assert one_b in (b, b + " end")
    assert left == sorted([(1, a), (1, one_b), (None, c), (2, d + " end"), (3, e), (4, ""), (None, ""), (None, ""), (None, None)], key=key)
    out = near_duplicates(docs).collect()
    assert len(out) == len(rows) and all(x.kept is not None for x in out)
    assert sorted(str(x.component_id) for x in out) == sorted(["1"] * 4 + ["None"] * 5 + ["2"] * 2 + ["3"] * 2 + ["4"])


def test_odd_tables(llm, tmp_path):
    """Empty tables, null ids and texts, repeated rows, ties and extra columns."""
    import corpus_pipeline as p

    ddl = "doc_id long, text string, lang string, source string, n_chars long, score double, own string, pid int, alone int, rep long"
    for name, columns in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("documents", ddl)):
        llm.createDataFrame([], columns).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert p.run(llm, f"{tmp_path}/none").count() == 0
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, long = prose(50), prose(30_000)
    rows = [(1, a), (1, a), (2, a), (None, None), (None, a + " end"), (3, None), (3, ""), (4, long), (5, prose(40))]
    rows = [(i, t, None, None, None, 0.5, "x", 7, 1, 2) for i, t in rows]
    docs = llm.createDataFrame(rows, ddl)
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    for name in ("labels", "benchmark"):
        llm.read.parquet(f"{tmp_path}/none/{name}.parquet").write.parquet(f"{tmp_path}/odd/{name}.parquet")
    out = p.run(llm, f"{tmp_path}/odd")
    got = [(x.doc_id, x.piece) for x in out.collect()]
    assert {i for i, _ in got} == {None, 1, 3, 4, 5} and len([1 for i, _ in got if i == 3]) == 2 and len([1 for i, _ in got if i == 1]) == 1
    assert out.where("doc_id = 4").agg(F.sum("length")).first()[0] > 30_000
    assert sorted(p.run(llm, f"{tmp_path}/odd").drop("sequence_id", "offset").collect(), key=str) == sorted(out.drop("sequence_id", "offset").collect(), key=str)
