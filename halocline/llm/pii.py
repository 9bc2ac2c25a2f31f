"""Personal data by weak supervision, in DataFrame functions only.

Spans of four kinds. The base finds emails, addresses, cards and phones by fixed patterns. Looser patterns propose more
candidates (written-out emails, addresses with colons, national phone numbers, shorter cards) and those of a fifth kind
that the base has not, secrets: long runs of hexadecimal digits or of mixed letters and digits. On every candidate,
base ones included, labelers vote for, against or not at all: the strict pattern, a shape check, a gazetteer of
domain endings and number prefixes, cue words before it, and its surroundings. Expectation-maximisation over the vote
patterns of the whole corpus (at most 3^5 for each kind) estimates each labeler's reliability and each pattern's
posterior. With these as soft labels a naive Bayes classifier of span features is trained, from one aggregate of the
whole corpus, and accepts the proposed spans that it finds likelier personal than not. Base spans always stay. What stands
behind a word for checksums and the like is no secret, whatever the other labelers say.

Positions are code points, end exclusive. Patterns are written so that a search takes time in proportion to the text:
a run of characters is entered at its start or where the last match ended, and never given back.

Cases: null and empty texts have no spans. Repeated rows have equal spans. Proposed spans that overlap a base span or
an earlier proposed one are dropped. Written-out emails have local parts and labels of the lengths that mail allows. Very
long texts are read whole; other columns, of any name, are not read. Without candidates only the base decides.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, table, written

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
# fixed values: the base patterns, entered at the start of a run (or after the last match) and possessive
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "phone": "+"}
# candidates that the base has not
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[({]\x20?at\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])(?![A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+(])(?<![0-9)][\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]|[\x20.-][0-9])",
    "secret": r"(?<![0-9A-Za-z_+/-])(?:[0-9A-Fa-f]{32,}+|(?=[A-Za-z_-]*+[0-9])[0-9A-Za-z_-]{24,}+)(?![0-9A-Za-z_+/-])",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|ipv6|ipv4|host|address|addr|client|server|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|mobile|cell|call|fax|telefon|teléfono|téléphone|handy)\b",
    "secret": r"(?i)(?:\b|_)(?:token|secret|password|passwd|pwd|api.?key|access.?key|private.?key|credentials?|bearer|auth)\b",
}
AGAINST = r"(?i)\b(?:isbn|issn|version|order|invoice|ticket|token|sha\d*|hash|id|no|ref|fig|section|page)\b[\x20.:=#\"]*$"
NO_SECRET = r"(?i)\b(?:sha\d*|md5|commit|revision|checksum|hash|digest|etag|integrity|uuid|guid)\b[\x20.:=#\"']*$"
GAZETTEER = {
    "email": r"(?i)(?:\.|dot\W{0,2})(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|us|eu|ch|at|it|nl|be|pt|mx|ar|ca|au)$",
    "ip": r"(?i)^(?:2[0-9a-f]{3}|f[cde][0-9a-f]{2}|0{1,4}|10|127|192|172)[:.]",
    "card": r"^(?:3[4-7]|4|5[1-5]|6(?:011|5)|2[2-7])",
    "phone": r"^\+?(?:1[\x20(-]|[2-9]|\(?[2-9][0-9]{2}\)?)",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|(?:sk|pk|gh[pousr]|xox[abp]|AKIA|AIza|eyJ)[0-9A-Za-z_-]+)$",
}
SHAPES = ("strict", "shape", "gazetteer", "cue", "around")
CONTEXT = 40


@dataclass(frozen=True)
class PiiParameters:
    rounds: int = 25  # of expectation-maximisation
    prior: float = 0.3
    accept: float = 0.5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    d = F.split(F.reverse(digits), "")
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(2 * x.cast("int") - F.when(x.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.filter(d, lambda x: x != ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    if kind == "ip":
        return x.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(_digits(x)).between(16, 19) & luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


_SPANS = "array<struct<kind:string,first:int,last:int,found:string>>"


def _no_spans() -> Column:
    return F.array().cast(_SPANS)


def matches(text: Column, kind: str, pattern: str, hint: Column) -> Column:
    """Where a pattern matches: the pieces between matches tell the positions."""

    def placed(pieces: Column) -> Column:
        def with_found(found: Column) -> Column:
            def step(a: Column, x: Column, i: Column) -> Column:
                first = a["at"] + F.length(pieces[i])
                span = F.struct(F.lit(kind).alias("kind"), first.alias("first"), (first + F.length(x)).alias("last"), x.alias("found"))
                return F.struct((first + F.length(x)).alias("at"), F.array_append(a["out"], span).alias("out"))

            numbered = F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
            start = F.struct(F.lit(0).alias("at"), _no_spans().alias("out"))
            return F.aggregate(numbered, start, lambda a, y: step(a, y["x"], y["i"]), lambda a: a["out"])

        return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_found)

    return F.when(hint, bind(F.split(text, pattern, -1), placed)).otherwise(_no_spans())


def _of(kind: str):
    return lambda x: _valid(kind, x["found"])


def base_spans(text: Column) -> Column:
    """Spans of the base, by kind as listed, then by place."""
    found = []
    for kind in KINDS:
        hint = F.contains(text, F.lit(_HINT[kind])) if kind in _HINT else text.rlike(BASE[kind])
        found.append(F.filter(matches(text, kind, BASE[kind], hint), _of(kind)))
    return F.concat(*found)


def proposed_spans(text: Column, base: Column) -> Column:
    """Candidates besides the base, none overlapping a base span or another that comes before it."""
    found = [matches(text, k, MORE[k], text.rlike(MORE[k])) for k in ALL_KINDS]
    meets = lambda a, b: (a["first"] < b["last"]) & (b["first"] < a["last"])
    free = F.filter(F.concat(*found), lambda x: ~F.exists(base, lambda b: meets(x, b)))
    return F.aggregate(free, _no_spans(), lambda a, x: F.when(F.exists(a, lambda b: meets(x, b)), a).otherwise(F.array_append(a, x)))


def _by_kind(kind: Column, patterns: dict[str, str], on: Column) -> Column:
    return reduce(lambda a, k: F.when(kind == k, on.rlike(patterns[k])).otherwise(a), ALL_KINDS, F.lit(False))


def votes(text: Column, x: Column, strict: Column) -> Column:
    """A labeler's vote is 1 for, -1 against, 0 none. Before and after are what stands around the span."""
    kind, found = x["kind"], x["found"]
    before = F.substr(text, F.greatest(x["first"] - CONTEXT, F.lit(0)) + 1, x["first"] - F.greatest(x["first"] - CONTEXT, F.lit(0)))
    after = F.substr(text, x["last"] + 1, F.lit(2))
    digits = _digits(found)
    shape = F.when(kind == "card", F.when(luhn(digits), 1).otherwise(-1)).when(kind == "phone", F.when(F.length(digits).between(8, 15), 1).when(F.length(digits) < 7, -1).otherwise(0)).when(kind == "ip", 1).when(kind == "secret", F.when(found.rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]") & (F.size(F.array_distinct(F.split(found, ""))) >= 10), 1).otherwise(-1)).otherwise(F.when(F.length(found).between(6, 120), 1).otherwise(-1))
    joined = before.rlike(r"[A-Za-z0-9_/\\=#]$") | after.rlike(r"^(?:[A-Za-z_/\\#]|[.,][0-9])")
    return F.struct(
        strict.cast("int").alias("strict"),
        shape.alias("shape"),
        F.when(_by_kind(kind, GAZETTEER, found), 1).otherwise(-1).alias("gazetteer"),
        F.when(F.when(kind == "secret", before.rlike(NO_SECRET)).otherwise(before.rlike(AGAINST)), -1).when(_by_kind(kind, CUES, before), 1).otherwise(0).alias("cue"),
        F.when(joined, -1).otherwise(0).alias("around"),
    )


def features(x: Column) -> Column:
    """Of a span itself, with few values each, for the final classifier."""
    found = x["found"]
    return F.array(
        F.concat(F.lit("length "), F.least(F.lit(12), F.floor(F.length(found) / 4)).cast("string")),
        F.concat(F.lit("digits "), F.least(F.lit(20), F.length(_digits(found))).cast("string")),
        F.concat(F.lit("marks "), F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(found, r"[A-Za-z0-9]", ""), ""))), "").substr(1, 6)),
        F.concat(F.lit("start "), F.when(found.rlike("^[0-9]"), "digit").when(found.rlike("^[A-Za-z]"), "letter").otherwise("mark")),
    )


def _expectation_maximisation(rows: list, p: PiiParameters) -> dict[tuple, float]:
    """Posterior of each vote pattern. rows: (pattern, count), at most 3^5; each labeler has odds for each vote and class."""
    share, total = p.prior, sum(n for _, n in rows)
    width = len(SHAPES)
    right = [{(1, 1): 0.7, (1, 0): 0.25, (1, -1): 0.05, (0, 1): 0.1, (0, 0): 0.3, (0, -1): 0.6} for _ in range(width)]
    post: dict[tuple, float] = {}
    for _ in range(p.rounds):
        for pattern, _n in rows:
            odds = [math.log(share), math.log(1 - share)]
            for j, v in enumerate(pattern):
                odds[0] += math.log(right[j][1, v])
                odds[1] += math.log(right[j][0, v])
            post[pattern] = 1 / (1 + math.exp(min(60.0, max(-60.0, odds[1] - odds[0]))))
        share = min(0.99, max(0.01, sum(post[x] * n for x, n in rows) / total))
        for j in range(width):
            for c in (0, 1):
                weight = {v: 1.0 for v in (-1, 0, 1)}
                for x, n in rows:
                    weight[x[j]] += n * (post[x] if c else 1 - post[x])
                all_ = sum(weight.values())
                for v in (-1, 0, 1):
                    right[j][c, v] = weight[v] / all_
    return post


def _posteriors(counted: DataFrame, p: PiiParameters) -> dict[str, dict[tuple, float]]:
    rows = counted.groupBy("kind", *[f"v.{s}" for s in SHAPES]).agg(F.count("*").alias("n")).collect()  # at most 4 * 3^5
    return {kind: _expectation_maximisation([(tuple(r[s] for s in SHAPES), r.n) for r in rows if r.kind == kind], p) for kind in {r.kind for r in rows}}


def detect(docs: DataFrame, p: PiiParameters | None = None, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, base (spans) and spans (all): a row for each of docs. Texts are read once and not shuffled.

    With whole, each row of docs comes along with its own spans, as the struct row.
    """
    row = ["row"] if whole else []
    p = p or PiiParameters()
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(F.col(key).alias("doc_id"), body.alias("t"), *([F.struct("*").alias("row")] if whole else [])).withColumn("base", base_spans(F.col("t")))
    first = first.withColumn("more", proposed_spans(F.col("t"), F.col("base")))
    voted = lambda spans, strict: F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["first"].alias("first"), x["last"].alias("last"), features(x).alias("f"), votes(F.col("t"), x, F.lit(strict)).alias("v")))
    rows = written(first.select("doc_id", *row, voted("base", 1).alias("base"), voted("more", 0).alias("more")), "candidates")
    each = rows.select(F.explode(F.concat("base", "more")).alias("x")).select("x.*")
    posterior = _posteriors(each, p)
    if not posterior:
        plain = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["first"].alias("first"), x["last"].alias("last")))
        return rows.select("doc_id", *row, plain.alias("base"), plain.alias("spans"))
    flat = [(k, *x, q) for k, of in sorted(posterior.items()) for x, q in sorted(of.items())]
    kinds = [pa.string(), *[pa.int32()] * len(SHAPES), pa.float64()]
    few = pa.table([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), kinds, strict=True)], names=["kind", *SHAPES, "q"])
    soft = F.broadcast(spark.createDataFrame(few))  # at most 4 * 3^5 rows; a list of rows would start Python workers, which stay
    joined = each.select("kind", "f", *[F.col(f"v.{s}").alias(s) for s in SHAPES]).join(soft, ["kind", *SHAPES])
    seen = joined.select("kind", "q", F.explode("f").alias("f")).groupBy("kind", "f").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).collect()  # at most some hundred feature values by kind
    sums = {k: (sum(r.yes for r in seen if r.kind == k), sum(r.no for r in seen if r.kind == k)) for k in posterior}
    weights = {(r.kind, r.f): math.log((r.yes + 1) / (sums[r.kind][0] + 2)) - math.log((r.no + 1) / (sums[r.kind][1] + 2)) for r in seen}
    pattern = {f"{k}|{','.join(map(str, x))}": math.log(max(q, 1e-9) / max(1 - q, 1e-9)) for k, of in posterior.items() for x, q in of.items()}
    table_of = lambda d: F.from_json(F.lit(json.dumps(d)), "map<string,double>")
    w, prior = table_of({f"{k}|{f}": v for (k, f), v in weights.items()}), table_of(pattern)

    def value(x: Column, w: Column, prior: Column) -> Column:
        label = F.concat(x["kind"], F.lit("|"), F.concat_ws(",", *[x["v"][s].cast("string") for s in SHAPES]))
        score = F.aggregate(x["f"], F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at(w, F.concat(x["kind"], F.lit("|"), f)), F.lit(0.0)))
        return F.coalesce(F.try_element_at(prior, label), F.lit(0.0)) + score / 4

    plain = lambda x: F.struct(x["kind"].alias("kind"), x["first"].alias("first"), x["last"].alias("last"))
    chosen = F.when(F.size("more") == 0, F.array().cast("array<struct<kind:string,first:int,last:int>>")).otherwise(bind(w, lambda w: bind(prior, lambda o: F.transform(F.filter("more", lambda x: (value(x, w, o) > math.log(p.accept / (1 - p.accept))) & ~((x["kind"] == "secret") & (x["v"]["cue"] < 0))), plain))))
    base = F.transform("base", plain)
    return rows.select("doc_id", *row, base.alias("base"), F.concat(base, chosen).alias("spans"))


def written_out(spans: Column) -> Column:
    """kind:start:end by kind as listed, then by start, comma-joined."""
    number = lambda k: F.array_position(F.array(*[F.lit(x) for x in ALL_KINDS]), k)
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct(number(x["kind"]).alias("n"), x["first"].alias("first"), x["last"].alias("last"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["last"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with each span (merged where they overlap) replaced by its kind in brackets."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        inside = x["first"] < a["at"]
        piece = F.substr(text, a["at"] + 1, F.greatest(x["first"] - a["at"], F.lit(0)))
        put = F.array_append(F.array_append(a["out"], piece), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(F.greatest(a["at"], x["last"]).alias("at"), F.when(inside, a["out"]).otherwise(put).alias("out"))

    done = bind(F.aggregate(ordered, start, step), lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1, F.length(text))))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, text).otherwise(done)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and spans, and all spans that the method gives."""
    rows = detect(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
