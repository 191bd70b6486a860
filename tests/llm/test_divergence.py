"""The source divergence audit against a brute-force version."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from masklake.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, term string, digest string, copies string"


def brute(rows, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df, every, counts = Counter(), Counter(), defaultdict(Counter)
        for g, source, words in docs:
            if g == lang:
                df.update(set(words))
                every.update(words)
                counts[source].update(words)
        kept = [t for t in df if df[t] >= 3]

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1000000000 * (count[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(every)
        f = lambda x, y: (x - y) * (x - y) // y
        for a in p:
            pairs = {b: sum(f(p[a][t], p[b][t]) for t in kept) for b in p if b != a}
            terms = {t: f(p[a][t], q[t]) for t in kept if counts[a][t] and p[a][t] > q[t]}
            for part, values, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, a, part, item, value, k) for k, (item, value) in enumerate(ranked[:limit], 1)}
    return out


def corpus():
    rng = random.Random(2)
    words = ["Alpha", "beta", "ÉTÉ", "été", "日本", "x2y", "don't", "a_b", "[c]"] + ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, prose(rng.randint(0, 60)), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", None, "hot", "hot", "hot"])) for k in range(300)]
    same = prose(40)
    rows += [(1000 + k, same, "en", "hot" if k % 3 else "b") for k in range(90)] + [(None, same, "fr", "a")] * 4
    rows += [(2000, None, "en", "nothing"), (2001, "", "en", "nothing"), (2002, "12 34", "de", "a"), (2003, None, "de", None), (2004, "once only", "it", "a")]
    rows += [(3000, "z" * 100_000 + " " + prose(20_000), "en", "a"), (3001, "z" * 100_000, "en", "b"), (3002, "Z" * 100_000, "en", "c")]
    return rows


def test_audit(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "t", "d", "c") for r in rows], SCHEMA).repartition(6)
    got = [tuple(r) for r in divergence.audit(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert {g[4] for g in got if g[0] == "de"} == {0}
    assert divergence.audit(df, top=3).where("part = 'term'").agg({"rank": "max"}).first()[0] == 3
    assert divergence.audit(df.limit(0)).count() == 0


def test_bounds_inside_tasks_change_nothing(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    sources = [[{"source": s, "copies": rng.randint(1, 5)} for s in rng.sample(["p", "q", "", "r"], rng.randint(1, 4))] for _ in texts]
    batch = pa.record_batch({"lang": pa.array([rng.choice(["x", "y"]) for _ in texts]), "text": pa.array(texts), "sources": pa.array(sources)})
    entries = [[{"source": s, "p": rng.randint(1, 10**9), "zero": rng.randint(1, 10**6)} for s in rng.sample("abcdef", rng.randint(2, 6))] for _ in range(50)]
    terms = pa.record_batch({"lang": pa.array([rng.choice(["x", "y"]) for _ in entries]), "entries": pa.array(entries)})

    def totals():
        n, docs, both = Counter(), Counter(), Counter()
        for part in divergence._count(iter([batch.slice(0, 31), batch.slice(31)])):
            for r in part.to_pylist():
                n[r["lang"], r["source"], r["term"]] += r["n"]
                docs[r["lang"], r["source"], r["term"]] += r["docs"]
        for part in divergence._both(iter([terms.slice(0, 7), terms.slice(7)])):
            for r in part.to_pylist():
                both[r["lang"], r["a"], r["b"]] += r["value"]
        return n, docs, both

    want = totals()
    for name, value in (("PAIR_ROWS", 5), ("HELD_ROWS", 40), ("PIECE_BYTES", 300)):
        monkeypatch.setattr(divergence, name, value)
    assert totals() == want
    for lang in "xy":
        tf = Counter()
        for t, g, s in zip(texts, batch.column("lang").to_pylist(), sources, strict=True):
            if g == lang:
                tf.update({(x["source"], w): c * x["copies"] for w, c in Counter(t.split()).items() for x in s})
        assert {(k[1], k[2]): v for k, v in want[0].items() if k[0] == lang} == tf


def test_shares_are_exact(spark):
    rng = random.Random(1)
    rows = [(c := rng.randrange(10 ** rng.randint(1, 15)), c + rng.randint(1, 10 ** rng.randint(1, 15))) for _ in range(2000)] + [(0, 1), (5, 6)]
    df = spark.createDataFrame(rows, "c bigint, t bigint")
    got = df.select("c", "t", divergence.share(df.c, df.t).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.t for r in got)
