"""PII; DataFrame functions only on the executors. Regex labelers find e-mail addresses, IP addresses, card and phone
numbers. Further candidate spans get votes of regex, gazetteer and context labelers; expectation-maximisation estimates
the labelers' reliabilities from how they agree, and its posteriors train the final classifier of spans.

Spans are in code points, end exclusive. What the base rules find always stays; added spans never overlap it.

Defined results: a null text is an empty one and has no span. With no candidate, nothing is added. Repeated rows get
equal spans, and each counts for the estimates. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

# The base patterns, by kind in the order of the result.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have so that a base pattern has a valid match: cheaper than all matches with their places.
GUARD = {"email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: The same valid matches as BASE, found in one pass and without recursion: a match starts where a run of its characters
#: starts (or where the one before ended), nothing is given back, and numbers too short for a card are no match at all.
ONE_PASS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": BASE["phone"],
}
#: Candidates for added spans: runs that mix letters and digits, and numbers in groups.
OTHER = {
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*[0-9])[A-Za-z0-9_/+-]{12,}",
    "number": r"(?<![0-9A-Za-z+.])\(?[0-9]{3}[)\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
_CUES = r"(?i)(token|secret|passw|api.?key|key|auth|bearer|credential|ssn|passport|iban|account|phone|tel|mobile|fax|call)[^\n]{0,12}$"
LABELERS = 5
#: Characters before a candidate that labelers see. Arrays are built in pieces of so many members.
CONTEXT, PIECE = 32, 128
ROUNDS, ACCEPT = 50, 0.5


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc,
        i: acc + _doubled(F.substring(digits, -i, F.lit(1)).cast("int"), i),
    )
    return total % 10 == 0


def _doubled(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, r"^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = F.regexp_replace(m, r"[\x20-]", "")
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(m, r"[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _scanned(items: Column, carry: str, out: str, step) -> Column:
    """What step(carry, item) gives out over an array, in order. step returns the next carry (a number) and a value to
    keep, or null. Arrays are built in pieces of PIECE and joined, so the work is in proportion to the array."""

    def inside(acc: Column, x: Column) -> Column:
        now, kept = step(acc["carry"], x)
        return F.struct(now.cast(carry).alias("carry"), F.when(kept.isNotNull(), F.array_append(acc["out"], kept)).otherwise(acc["out"]).alias("out"))

    def outside(acc: Column, piece: Column) -> Column:
        start = F.struct(acc["carry"].alias("carry"), F.expr(f"cast(array() as array<{out}>)").alias("out"))
        return let(
            F.aggregate(piece, start, inside),
            lambda done: F.struct(done["carry"].alias("carry"), F.array_append(acc["out"], done["out"]).alias("out")),
        )

    def whole(all_of: Column) -> Column:
        pieces = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_of) - 1) / PIECE).cast("int")),
            lambda i: F.slice(all_of, i * PIECE + 1, F.lit(PIECE)),
        )
        start = F.struct(F.lit(0).cast(carry).alias("carry"), F.expr(f"cast(array() as array<array<{out}>>)").alias("out"))
        found = F.aggregate(pieces, start, outside, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(all_of) > 0, found).otherwise(F.expr(f"cast(array() as array<{out}>)"))

    return let(items, whole)


_SPAN = "struct<start:int,end:int,found:string,before:string>"


def spans(kind: str, pattern: str, guard: str, text: Column) -> Column:
    """Valid matches of a pattern, leftmost and non-overlapping, with their places: sums of the lengths of the matches and
    of what is between them, so a text with very many matches isn't searched again for each. before: the last characters
    between the match before and this one.
    """

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["gap"])
        end = begin + F.length(x["found"])
        return end, F.when(
            _valid(kind, x["found"]),
            F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("found"), F.substring(x["gap"], -CONTEXT, CONTEXT).alias("before")),
        )

    pieces = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda m,
        gap: F.struct(m.alias("found"), gap.alias("gap")),
    )
    all_of = _scanned(F.filter(pieces, lambda x: x["found"].isNotNull()), "int", _SPAN, step)
    return F.when(text.rlike(guard), all_of).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def _outside(own: Column, others: Column, fields: str) -> Column:
    """Members of `own` (spans with start and end) that overlap none of `others`: in one order, by the end of the former and
    the start of the latter, a span is free if no other that starts before its end goes beyond its start."""
    empty = F.lit(None).cast(f"struct<{fields}>")
    mark = lambda key, last, to, x: F.struct(key.alias("key"), last.alias("last"), to.alias("to"), x.alias("x"))
    both = F.concat(
        F.transform(others, lambda o: mark(o["start"], F.lit(1), o["end"], empty)),
        F.transform(
            own,
            lambda c: mark(c["end"], F.lit(0), F.lit(0), F.struct(*(c[f.split(":")[0]].alias(f.split(":")[0]) for f in fields.split(",")))),
        ),
    )

    def step(far: Column, x: Column) -> tuple[Column, Column]:
        return F.greatest(far, x["to"]), F.when((x["last"] == 0) & (far <= x["x"]["start"]), x["x"])

    free = let(_scanned(F.array_sort(both), "int", f"struct<{fields}>", step), lambda found: F.array_sort(found))
    return F.when((F.size(own) > 0) & (F.size(others) > 0), free).otherwise(own)


def _votes(x: Column) -> Column:
    """The labelers' votes on a span: 1 for personal, -1 against, 0 for none. And features for the final classifier."""
    found, before = x["found"], x["before"]
    digits = F.length(F.regexp_replace(found, "[^0-9]", ""))
    share = digits / F.length(found)
    hexes = found.rlike(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$") & found.rlike("[A-Fa-f]")
    regex = F.when(
        hexes | found.rlike(r"^(ghp|sk|pk|AKIA|xox)[A-Za-z0-9_-]{12,}$") | (x["kind"] == "number"),
        1,
    ).when(found.rlike(r"[a-z]-[a-z]|/"), -1).otherwise(0)
    gazetteer = F.when(before.rlike(_CUES), 1).otherwise(0)
    context = F.when(before.rlike(r"[=:]\s*[\"']?$"), 1).when(before.rlike(r"[A-Za-z]\s$"), 0).otherwise(-1)
    shape = F.when(share.between(0.2, 0.95) & (F.length(found) >= 16), 1).when(share < 0.1, -1).otherwise(0)
    length = F.when(F.length(found) >= 24, 1).when(F.length(found) < 14, F.when(x["kind"] == "number", 0).otherwise(-1)).otherwise(0)
    pattern = (regex + 1) + 3 * (gazetteer + 1) + 9 * (context + 1) + 27 * (shape + 1) + 81 * (length + 1)
    cell = F.when(x["kind"] == "number", 1).otherwise(0) + 2 * F.least(F.floor(F.length(found) / 8), F.lit(7)) + 16 * F.floor(share * 4).cast("int") + 80 * F.when(before.rlike(r"[=:]\s*[\"']?$"), 1).otherwise(0) + 160 * gazetteer + 320 * hexes.cast("int")
    return F.struct(
        x["start"].alias("start"),
        x["end"].alias("end"),
        x["kind"].alias("kind"),
        pattern.cast("int").alias("pattern"),
        cell.cast("int").alias("cell"),
    )


def reliabilities(patterns: dict[int, int]) -> dict[int, float]:
    """Posterior of each vote pattern (counts by pattern), by expectation-maximisation over a two-class model in which
    labelers vote independently given the class."""
    keys = np.array(sorted(patterns))
    n = np.array([patterns[k] for k in keys], float)
    votes = np.stack([keys // 3**j % 3 for j in range(LABELERS)], axis=1)
    post = 1 / (1 + np.exp(-2.0 * (votes - 1).sum(axis=1)))  # majority to begin with
    for _ in range(ROUNDS):
        prior = (n @ post + 1) / (n.sum() + 2)
        score = np.full(len(keys), np.log(prior) - np.log(1 - prior))
        for j in range(LABELERS):
            for v in range(3):
                mine = votes[:, j] == v
                yes, no = (n[mine] @ post[mine] + 1) / (n @ post + 3), (n[mine] @ (1 - post[mine]) + 1) / (n @ (1 - post) + 3)
                score[mine] += np.log(yes) - np.log(no)
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return dict(zip(keys.tolist(), post.tolist(), strict=True))


def classifier(cells: dict[int, tuple[float, float]]) -> list[int]:
    """Cells of features that a logistic regression, trained on posterior sums, accepts. cells: (sum, count) by cell."""
    keys = np.array(sorted(cells))
    y, n = (np.array([cells[k][i] for k in keys], float) for i in (0, 1))
    parts = (keys % 2, keys // 2 % 8, keys // 16 % 5, keys // 80 % 2, keys // 160 % 2, keys // 320)
    x = np.concatenate([np.ones((len(keys), 1)), *(np.eye(w)[p] for p, w in zip(parts, (2, 8, 5, 2, 2, 2), strict=True))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps with a weak prior
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - n * p) - 0.1 * w
        w += np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w)), grad)
    return [int(k) for k, z in zip(keys, x @ w, strict=True) if z > np.log(ACCEPT / (1 - ACCEPT))]


def _named(kind: str, found: Column) -> Column:
    return F.transform(
        found,
        lambda x: F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.lit(kind).alias("kind"),
            x["found"].alias("found"),
            x["before"].alias("before"),
        ),
    )


def _joined(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def find(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and n_spans (all) for each row of documents."""
    text = F.col("__t")
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    own = own.withColumns({k: spans(k, p, GUARD[k], text) for k, p in ONE_PASS.items()})
    own = own.withColumns({f"other_{k}": _named(k, spans(k, p, r"[0-9]", text)) for k, p in OTHER.items()})
    base = F.concat(*BASE)
    found = F.concat(*(f"other_{k}" for k in OTHER))
    free = _outside(found, base, "start:int,end:int,kind:string,found:string,before:string")
    plain = {k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in BASE}
    seen = materialize(own.select("doc_id", *plain.values(), F.transform(free, lambda x: _votes(x)).alias("other")), "spans")
    every = seen.select(F.explode("other").alias("x")).select("x.*")
    patterns = {r[0]: r[1] for r in every.groupBy("pattern").count().collect()}  # 243 rows at most
    good: list[int] = []
    if patterns:
        post = F.create_map(*(F.lit(v) for kv in reliabilities(patterns).items() for v in kv))
        sums = every.groupBy("cell").agg(F.sum(F.element_at(post, F.col("pattern"))).alias("p"), F.count("*").alias("n"))
        good = classifier({r[0]: (r[1], r[2]) for r in sums.collect()})  # 640 rows at most
    added = F.filter("other", lambda x: x["cell"].isin(good)) if good else F.filter("other", lambda x: F.lit(False))
    # of added spans that overlap, the first by kind stays
    lists = [_joined(k, F.col(k)) for k in BASE]
    secret = F.filter("added", lambda x: x["kind"] == "secret")
    number = _outside(F.filter("added", lambda x: x["kind"] == "number"), secret, "start:int,end:int,kind:string,pattern:int,cell:int")
    out = seen.withColumn("added", added)
    out = out.withColumn("more", F.concat(_joined("secret", secret), _joined("number", number)))
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.concat(*lists), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*lists, "more"), ",").alias("spans"),
        F.size("more").cast("long").alias("n_added"),
        (F.size(F.concat(*lists)) + F.size("more")).cast("long").alias("n_spans"),
    )
