"""Cases that an earlier form of the operators left out."""

import random
from collections import Counter

from pyspark.sql import functions as F

from masklake.llm import decontaminate, linededup

from brute import brute_lines


def test_line_dedup_removes_short_lines(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(k, f"Read more\n\n \t\nAll  rights\tRESERVED\n{k} only here\nread\na b c d\na b c d e\n{long} {k}\nmore read") for k in range(12)]
    rows += [(20, "READ MORE \nread more now\nread\nread read\na b c d e\nb c d e\na b c d"), (21, None), (22, ""), (23, "\n\n"), (None, "read more")]
    want = brute_lines(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {(r.doc_id, r.line_no) for r in linededup.removed_lines(df).collect()} == want
    assert {(1, 0), (1, 3), (5, 5), (5, 6), (5, 7), (5, 8), (20, 0), (20, 2), (20, 6)} <= want and not {(1, 1), (1, 2), (1, 4), (20, 1), (20, 3), (20, 5)} & want
    texts = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert texts[1] == "\n \t\n1 only here" and texts[20] == "read more now\nread read\nb c d e" and texts[23] == "\n\n"


def test_decontamination_keeps_rows_one_for_one_in_blocks(spark):
    rows = [(None, "one two three"), (None, "four five six"), (None, "four five six"), (7, "one two three"), (7, "six two three"), (7, "one two three"), (8, None)]
    items = [(1, "two three"), (2, "four five"), (3, "six two"), (4, "five six")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = Counter([(None, 3, ((1, 3),), ("1",)), (7, 3, ((1, 3),), ("1",)), (7, 3, ((1, 3),), ("1",)), (7, 3, ((0, 3),), ("1", "3")), (8, 0, (), ())]
                   + [(None, 3, ((0, 3),), ("2", "4"))] * 2)
    for bound in (1 << 20, 80):
        got = decontaminate.find_benchmark(df, benchmark, block_bytes=bound).collect()
        assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.spans)), tuple(r["items"])) for r in got) == want


def test_decontamination_with_repeated_and_missing_item_ids(spark, tmp_path):
    import duckdb

    from masklake.llm.queries import OP10_SQL

    rows = [(1, "zero two three four"), (2, "five six seven"), (3, "two three five six"), (4, "eight"), (5, None)]
    items = [("A", "two three"), ("A", "two three"), ("A", "three four"), (None, "five six"), (None, "eight"), ("B", "six seven"), ("C", None)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", benchmark)):
        df.write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({OP10_SQL})").fetchall())
    assert [w[2:4] for w in want] == [(3, 1), (3, 1), (4, 1), (1, 0), (0, 0)]
    for bound in (1 << 20, 150):
        assert sorted(map(tuple, decontaminate.report(decontaminate.find_benchmark(docs, benchmark, block_bytes=bound)).collect())) == want


def test_pipeline_stages_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b, c, d, e, f = (prose(60) for _ in range(6))
    rows = [(None, a), (None, b), (5, c), (5, c), (5, c), (6, d), (7, d), (None, d), (8, e), (8, f), (None, f), (None, f)]
    rows = [(i, t, "en", "s", len(t)) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    spark.createDataFrame([(1, " ".join(b.split()[10:30])), (2, " ".join(e.split()[10:30]))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df.write.parquet(str(tmp_path / "documents"))
    df = spark.read.parquet(str(tmp_path / "documents"))
    pairs = lambda out: Counter((r.doc_id, r.text) for r in out.collect())
    once = Counter([(None, a), (None, b), (5, c), (6, d), (8, e), (8, f)])
    assert pairs(P.dedup_lines(spark, df, str(tmp_path))) == once
    assert pairs(P.drop_near_duplicates(spark, df, str(tmp_path))) == once
    assert pairs(P.decontaminate_benchmark(spark, df, str(tmp_path))) == Counter((i, t) for i, t, *_ in rows if t not in (b, e))
    mixed = P.mix_sources(spark, df, str(tmp_path)).withColumn("words", F.lit(60) * F.col("copies")).collect()
    assert abs(sum(r.words for r in mixed) - 1.5 * 60 * len(rows)) <= 60 and {r.copies for r in mixed} <= {1, 2}
    assert not Counter((r.doc_id, r.text) for r in mixed) - Counter((i, t) for i, t, *_ in rows) and any(r.doc_id is None for r in mixed)
    again = P.mix_sources(spark, df.repartition(2), str(tmp_path)).collect()
    assert sorted(map(repr, again)) == sorted(repr(r).replace(f", words={r.words})", ")") for r in mixed)


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(4)
    names = ["_id", "place", "copies", "lines_removed", "lang_pred", "lang_score", "row", "kept0", "class_id", "size", "spans", "items", "key"]
    words = [f"{a}{b}" for a in ("lorem", "dolor", "amet", "elit") for b in ("us", "is", "or", "et", "um")]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    base = prose(60)
    texts = [prose(50) + "\n" + (base.split()[0] if k % 9 else base) for k in range(40)] + [base, base + " end", prose(3), "Hi"]
    for repeated in (False, True):
        rows = [(None if repeated and k == 5 else 3 if repeated and k == 7 else k, t, "en", f"s{k % 3}", len(t), *[f"{n}-{k}" for n in names]) for k, t in enumerate(texts)]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names)
        path = tmp_path / str(repeated)
        spark.createDataFrame(rows, schema).write.parquet(str(path / "documents.parquet"))
        spark.createDataFrame([(1, " ".join(texts[4].split()[5:30]))], "item_id bigint, text string").write.parquet(str(path / "benchmark.parquet"))
        docs, own = spark.read.parquet(str(path / "documents.parquet")), {r[5]: r for r in rows}
        for k, (_, stage) in enumerate(P.STAGES):
            stage(spark, docs, str(path)).write.parquet(str(path / f"stage{k}"))
            docs = spark.read.parquet(str(path / f"stage{k}"))
            got = docs.collect()
            assert got and len({r["_id"] for r in got}) == len(got)
            last = k == len(P.STAGES) - 1
            assert docs.columns == ([c for c in schema.replace(" string", "").replace(" bigint", "").split(", ") if not (last and c == "copies")] + ["copies"] * last)
            for r in got:
                want = own[r["_id"]]
                assert r.doc_id == want[0] and all(r[n] == want[5 + j] for j, n in enumerate(names) if not (last and n == "copies"))
            if k == 0:
                assert {len(texts) - 1, len(texts) - 2} <= {int(r["_id"].split("-")[1]) for r in got}
        assert own["_id-4"][1] not in {r.text for r in got}
        assert sorted(map(repr, P.run(spark, str(path)).collect())) == sorted(map(repr, got))
