"""Personal data by weak supervision, in DataFrame operations only.

Regular expressions propose spans of several kinds. Labelers then vote on every proposed span, +1, -1 or 0: a strict form, a
gazetteer, the words before it, a checksum or range, and a test for made-up values. Expectation-maximisation over the counts of vote
patterns (at most 3 ** 5 for each kind, whatever the corpus) estimates how often each labeler votes which way on true and on
false spans, and with it each pattern's probability. These probabilities are the soft labels of a naive Bayes span classifier over the
span's own features; its sums come from one aggregation over all spans. Spans of the base kinds that pass their checks always
stay; spans of the further kinds stay if the classifier gives them `ACCEPT` or more.

Positions come from splitting the text by the same expression that extracts its matches: a match starts after all earlier pieces
and matches. The expressions start at run borders and are possessive, so that a long run costs one pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from masklake.session import materialize

ACCEPT = 0.5
CONTEXT = 40
ROUNDS = 40

#: Fixed value: kinds in their listed order; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "ssn", "tel", "name"]
BASE = 4

GIVEN_NAMES = ["James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara",
               "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Anna", "Maria", "Peter", "Hans",
               "Claude", "Pierre", "Marie", "Sophie", "Klaus", "Carlos", "Juan", "Lucia", "Carmen", "Jose"]
#: What can only be part of a longer run of the same kind is not a start; after a match the search goes on where it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+(). -])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "name": r"\b(?=[A-Z])(?:(?:Mr|Mrs|Ms|Dr)\.? [A-Z][a-z]++|(?:" + "|".join(GIVEN_NAMES) + r") [A-Z][a-z]++)(?: [A-Z][a-z]++)?",
}
#: A cheap test that every text with a match passes.
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.contains("+"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    "tel": lambda t: t.rlike(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    "name": lambda t: t.rlike(PATTERNS["name"]),
}
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info"]
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|30|36|38)"
CONTEXT_WORDS = {
    "email": r"mail|contact|write|address|reach", "ip": r"\bip\b|host|server|address|login|from", "card": r"card|visa|credit|pay|account",
    "phone": r"phone|tel|call|mobile|fax|contact", "ssn": r"ssn|social|security|tax", "tel": r"phone|tel|call|mobile|fax|contact",
    "name": r"name|author|contact|dear|by $|from|sincerely",
}
AGAINST = r"version|isbn|issn|section|chapter|page|figure|table|order no|part no|serial|release|build"
VOTES = ["v_form", "v_gazetteer", "v_context", "v_check", "v_real"]


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, print (of the text), kind (its number), start, end, match, before (up to `CONTEXT` characters), one row for each match."""
    text = F.col("text")
    found = []
    for number, kind in enumerate(KINDS):
        pattern = F.lit(PATTERNS[kind])
        both = F.struct(F.lit(number).alias("kind"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"),
                        F.split(text, PATTERNS[kind], -1).alias("pieces"))
        found.append(F.when(GATES[kind](text), both))
    kinds = docs.select("doc_id", "print", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull() & (F.size(x["matches"]) > 0))).alias("f"))
    parts = F.transform(F.col("f.matches"), lambda m, i: F.struct(
        m.alias("match"), F.length(F.get(F.col("f.pieces"), i)).alias("gap"), F.substring(F.get(F.col("f.pieces"), i), -CONTEXT, CONTEXT).alias("before")))
    rows = kinds.select("doc_id", "print", F.col("f.kind").alias("kind"), F.posexplode(parts).alias("i", "m")).select("doc_id", "print", "kind", "i", "m.*")
    rows = rows.dropDuplicates(["doc_id", "print", "kind", "i"])
    passed = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("doc_id", "print", "kind").orderBy("i"))
    return rows.select("doc_id", "print", "kind", (passed - F.length("match")).alias("start"), passed.alias("end"), "match", "before")


def _digits() -> Column:
    return F.regexp_replace("match", r"[^0-9]", "")


def _by_kind(cases: dict[str, Column], other: Column) -> Column:
    out = None
    for kind, column in cases.items():
        here = F.col("kind") == KINDS.index(kind)
        out = F.when(here, column) if out is None else out.when(here, column)
    return out.otherwise(other)


def _valid() -> Column:
    """Whether a span passes the check of its kind."""
    digits, n = _digits(), F.length(_digits())
    byte = r"^0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$|^0++$"
    return _by_kind({
        "email": F.lit(True), "ip": F.forall(F.split("match", r"\."), lambda p: p.rlike(byte)),
        "card": F.when(n.between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False)), "phone": n.between(9, 15),
        "ssn": ~F.col("match").rlike(r"^(?:000|666|9)|-00-|-0000$"), "tel": ~digits.rlike(r"^[01]|^...[01]"),
    }, F.lit(True))


def _sign(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return out.otherwise(F.lit(-1)) if no is None else out.when(no, F.lit(-1)).otherwise(F.lit(0))


def with_votes(spans: DataFrame) -> DataFrame:
    """`spans` with `valid`, the labelers' votes and the classifier's features."""
    match, digits = F.col("match"), _digits()
    low = F.lower("before")
    form = _by_kind({
        "email": match.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), "ip": match.rlike(r"^[1-9]"),
        "card": match.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$"), "phone": match.rlike(r"^\+[1-9][0-9]{0,2}[ (.-]"),
        "ssn": F.lit(True), "tel": match.rlike(r"^\([0-9]{3}\) |^([0-9]{3})-[0-9]{3}-"), "name": match.rlike(r"^[A-Z][a-z]+ [A-Z][a-z]{2,}$"),
    }, F.lit(False))
    gazetteer = _by_kind({
        "email": F.lower(F.substring_index("match", ".", -1)).isin(TOP_DOMAINS), "ip": match.rlike(r"^(?:10|127|172|192)\."),
        "card": digits.rlike(ISSUERS), "phone": match.rlike(CALLING_CODES), "ssn": F.lit(False), "tel": digits.rlike("^[2-9][0-8]"),
        "name": F.substring_index("match", " ", 1).isin(GIVEN_NAMES),
    }, F.lit(False))
    hint = _by_kind({k: low.rlike(w) for k, w in CONTEXT_WORDS.items()}, F.lit(False))
    made_up = digits.rlike(r"^([0-9])\1{6,}$|0123456|1234567|^0+$") | F.lower("match").rlike(r"example\.|test@|@localhost|noreply")
    valid = _valid()
    n = F.length("match")
    share = F.when(n > 0, F.floor(4 * F.length(digits) / n)).otherwise(F.lit(0)).cast("string")
    word = F.regexp_extract(F.lower("before"), r"([\p{L}]+)[^\p{L}]*$", 1)
    return spans.select("*", valid.alias("valid"), _sign(form).alias("v_form"), _sign(gazetteer, F.lit(False)).alias("v_gazetteer"),
                        _sign(hint, low.rlike(AGAINST)).alias("v_context"), _sign(valid).alias("v_check"), _sign(F.lit(False), made_up).alias("v_real"),
                        F.least(F.floor(n / 4), F.lit(8)).cast("string").alias("f_length"), share.alias("f_digits"),
                        F.pmod(F.xxhash64(word), F.lit(64)).cast("string").alias("f_word"))


FEATURES = ["f_length", "f_digits", "f_word"]


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[dict, dict]:
    """Expectation-maximisation over (kind, votes, count): ({(kind, votes): probability}, {kind: share of true spans}).

    For each labeler, truth and vote it learns P(vote | truth), labelers being independent given the truth; a kind has its own share of true spans.
    """
    prob = {(k, v): 1 / (1 + math.exp(-sum(v))) for k, v, _ in patterns}
    share: dict[int, float] = {}
    for _ in range(rounds):
        said = {(i, y, vote): 1.0 for i in range(len(VOTES)) for y in (0, 1) for vote in (-1, 0, 1)}
        true, every = {k: 1.0 for k, _, _ in patterns}, {k: 2.0 for k, _, _ in patterns}
        for k, votes, n in patterns:
            p = prob[k, votes]
            true[k] += n * p
            every[k] += n
            for i, vote in enumerate(votes):
                said[i, 1, vote] += n * p
                said[i, 0, vote] += n * (1 - p)
        share = {k: true[k] / every[k] for k in true}
        total = {(i, y): sum(said[i, y, vote] for vote in (-1, 0, 1)) for i in range(len(VOTES)) for y in (0, 1)}
        for k, votes, _ in patterns:
            odds = math.log(share[k] / (1 - share[k]))
            for i, vote in enumerate(votes):
                odds += math.log(said[i, 1, vote] / total[i, 1]) - math.log(said[i, 0, vote] / total[i, 0])
            prob[k, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prob, share


def classified(voted: DataFrame) -> DataFrame:
    """`voted` with `probability`, from a naive Bayes classifier trained on the labelers' combined labels."""
    spark = voted.sparkSession
    counts = voted.groupBy("kind", *VOTES).count().collect()  # at most len(KINDS) * 3 ** 5 rows
    prob, _ = reliabilities([(r.kind, tuple(r[v] for v in VOTES), r["count"]) for r in counts])
    schema = ", ".join(["kind int", *(f"{v} int" for v in VOTES), "soft double"])
    soft = spark.createDataFrame([(k, *v, p) for (k, v), p in prob.items()], schema)
    labelled = voted.join(F.broadcast(soft), ["kind", *VOTES])
    # sums of soft labels by kind and feature value: a table of bounded size, from all spans in one aggregation
    values = F.array(F.struct(F.lit("").alias("feature"), F.lit("").alias("value")),
                     *[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])
    sums = (labelled.select("kind", "soft", F.explode(values).alias("v")).groupBy("kind", "v.feature", "v.value")
            .agg(F.sum("soft").alias("yes"), F.sum(1 - F.col("soft")).alias("no")))
    whole = sums.where("feature = ''").select("kind", F.col("yes").alias("all_yes"), F.col("no").alias("all_no"))
    weight = F.when(F.col("feature") == "", F.log((F.col("yes") + 1) / (F.col("no") + 1))).otherwise(
        F.log((F.col("yes") + 1) / (F.col("all_yes") + 20)) - F.log((F.col("no") + 1) / (F.col("all_no") + 20)))
    weights = materialize(sums.join(F.broadcast(whole), "kind").select("kind", "feature", "value", weight.alias("w")), "span-weights")
    odds, out = None, voted
    for f in ["", *FEATURES]:
        part = weights.where(F.col("feature") == f).select("kind", F.col("value").alias(f or "_"), F.col("w").alias(f"w_{f}"))
        out = out.join(F.broadcast(part.drop("_") if not f else part), ["kind", f] if f else ["kind"])
        odds = F.col(f"w_{f}") if odds is None else odds + F.col(f"w_{f}")
    return out.withColumn("probability", 1 / (1 + F.exp(-odds))).drop(*[f"w_{f}" for f in ["", *FEATURES]])


def _print() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def find_personal(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, print (of the text), kind (name), start, end (code points, end exclusive), probability, base: all spans that stay.

    Null and empty texts have none. A document is its id, null or not, with its text: rows that repeat both are found once. Other columns are not
    read. Whole texts are searched. An empty table, or one without any span, gives an empty result.
    """
    rows = docs.select("doc_id", _print().alias("print"), F.coalesce("text", F.lit("")).alias("text"))
    voted = materialize(with_votes(proposals(rows)), "span-votes")
    spans = classified(voted)
    base = F.col("kind") < BASE
    kept = spans.where(F.when(base, F.col("valid")).otherwise(F.col("probability") >= accept))
    return kept.select("doc_id", "print", F.col("kind").alias("kind_number"), F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("kind"),
                       "start", "end", "probability", base.alias("base"))


def report(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """For each row of `docs`: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (as text)."""
    listed = F.array_sort(F.collect_list(F.struct("kind_number", "start", "end", "kind", "base")))
    by_doc = spans.groupBy(F.col("doc_id").alias("id"), "print").agg(listed.alias("s"))
    rows = docs.select("doc_id", _print().alias("own"))
    joined = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("print")), "left").withColumn("s", F.coalesce("s", F.array().cast(by_doc.schema["s"].dataType)))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("s", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")
    base = F.filter("s", lambda s: s["base"])
    return joined.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:BASE]],
                         F.sha2(F.concat_ws(",", F.transform(base, text)), 256).alias("base_sha256"),
                         F.concat_ws(",", F.transform("s", text)).alias("spans"))
