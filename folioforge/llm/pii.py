"""Personal data by candidate gradient boosting: generators propose spans, boosted trees select.

Everything over documents is DataFrame expressions: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.boosting import Model, fit
from folioforge.sources.files import table

KINDS = ("email", "ip", "card", "phone", "secret", "id", "iban")
#: Rows of the labelled sample: half of it fits the trees, a quarter calibrates them, a quarter sets the threshold.
SAMPLE_ROWS = 2000

# Possessive and anchored at the start of a run, these find what the plain patterns find, without
# their repeated attempts and their recursion on long texts.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators beyond these: (kind, a cheap necessary test, pattern).
PROPOSERS = (
    ("email", r"(?i)[\[(]at[\])]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[a-z0-9-]{1,63}+(?: ?(?:\.|[\[(]dot[\])]| dot ) ?[a-z0-9-]{2,63}+){1,4}"),
    ("email", r"(?i) at ", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,64}+ at [a-z0-9-]{2,63}+(?:(?:\.| dot )[a-z0-9-]{2,63}+){1,4}"),
    ("phone", r"[0-9][ .)-]", r"(?<![0-9A-Za-z.@+-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9A-Za-z])"),
    ("card", r"[0-9]{4}", r"(?<![0-9A-Za-z.+-])[0-9]{4}[ -]?[0-9]{4,6}[ -]?[0-9]{4,5}(?:[ -]?[0-9]{1,4})?(?![0-9A-Za-z]|[.-][0-9A-Za-z])"),
    ("secret", r"[=:]", r"(?i)(?<![a-z0-9])(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|key|id|value)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[a-z0-9_/+.-]{8,}+[\"']?"),
    ("id", r"[0-9]-[0-9]", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
)
_FOR = r"phone|tel|call|mobile|cell|fax|dial|card|visa|master|amex|credit|mail|contact|write|reach|ssn|social|passport|iban|account|bank|token|secret|password|key"
_AGAINST = r"order|isbn|invoice|version|part|serial|ref|page|figure|item|sku|lot|build|look|arrive|meet|stay|model"
FEATURES = ("f_kind", "f_length", "f_digits", "f_letters", "f_signs", "f_variety", "f_luhn", "f_for", "f_against", "f_marked", "f_mixed")


def _luhn(digits: Column) -> Column:
    places = F.reverse(F.filter(F.split(digits, ""), lambda d: d != ""))
    worth = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


_VALID = {
    "email": lambda body: F.lit(True),
    "ip": lambda body: body.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"),
    "card": lambda body: F.when(F.length(_digits(body)).between(16, 19), _luhn(_digits(body))).otherwise(False),
    "phone": lambda body: F.length(_digits(body)).between(8, 15),
}
_SPANS = "array<struct<start:int,end:int,body:string,before:string,after:string>>"


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, also where lambdas in `use` refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Elements that are gone through one by one; longer arrays are cut into pieces of so many, to avoid quadratic work.
_PIECE = 256


def _cut_up(values: Column) -> Column:
    count = F.ceil(F.size(values) / F.lit(_PIECE)).cast("int")
    return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("CAST(array() AS array<int>)")), lambda k: F.slice(values, k * _PIECE + 1, F.lit(_PIECE)))


def _running(values: Column) -> Column:
    """Running sums of an array of integers."""
    append = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, F.lit(-1)) + x))

    def sums(pieces: Column) -> Column:
        totals = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        firsts = F.aggregate(totals, F.array(F.lit(0)), append)
        return _let(firsts, lambda f: F.flatten(F.transform(pieces, lambda p, k: F.slice(F.aggregate(p, F.array(F.get(f, k)), append), F.lit(2), F.size(p)))))

    return _let(_cut_up(values), sums)


def _spans(text: Column, pattern: str, test: str | None = None) -> Column:
    """Leftmost matches that do not overlap: start and end in code points, the match, and what stands around it."""

    def place(bodies: Column) -> Column:
        def beside(gaps: Column) -> Column:
            sizes = F.transform(bodies, lambda x, i: F.length(x) + F.length(F.get(gaps, i)))

            def span(ends: Column):
                return F.transform(
                    bodies,
                    lambda x, i: F.struct(
                        (F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end"), x.alias("body"),
                        F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"),
                    ),
                )

            return _let(_running(sizes), span)

        return _let(F.split(text, pattern, -1), beside)

    made = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)
    return F.when(text.rlike(test or pattern), made).otherwise(F.expr(f"CAST(array() AS {_SPANS})"))


def _features(kind: Column, c: Column) -> list[Column]:
    body, near = c["body"], F.lower(c["before"])
    digits, length = _digits(body), F.length(body)
    letters = F.length(F.regexp_replace(body, "[^A-Za-z]", ""))
    variety = F.size(F.array_distinct(F.split(body, ""))) / length
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    number = lambda x: x.cast("double")
    return [
        kind.cast("double"), number(length), number(F.length(digits)), number(letters), number(length - letters - F.length(digits)), number(variety),
        flag(F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)), flag(near.rlike(_FOR) | F.lower(body).rlike("token|secret|passw|api")), flag(near.rlike(_AGAINST)),
        flag(body.rlike(r"(?i)\[at\]|\(at\)|\[dot\]|\(dot\)| dot ")), flag(body.rlike("[0-9][A-Za-z]+[0-9]")),
    ]


def _base_spans(kind: str, pattern: str) -> Column:
    valid = F.filter(_spans(F.col("text"), pattern), lambda c: _VALID[kind](c["body"]))
    return F.transform(valid, lambda c: F.struct(F.lit(KINDS.index(kind)).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), F.lit(1.0).alias("p")))


def _described(number: int, kind: str):
    def run(c: Column) -> Column:
        features = (f.alias(n) for f, n in zip(_features(F.lit(number), c), FEATURES, strict=True))
        return F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), *features)

    return run


def _candidates(text: Column) -> Column:
    """Proposed spans of all generators, overlapping ones included, with their features."""
    parts = []
    for k, (kind, test, pattern) in enumerate(PROPOSERS):
        parts.append(F.transform(_spans(text, pattern, test), _described(k, kind)))
    return F.concat(*parts)


def _ranges(spans: Column) -> Column:
    """Spans by their start, cut into pieces with the range that each covers."""
    pieces = _cut_up(F.array_sort(F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), *(c[x].alias(x) for x in ("rank", "p"))))))
    return F.transform(pieces, lambda q: F.struct(F.get(q, F.lit(0))["start"].alias("low"), F.array_max(F.transform(q, lambda o: o["end"])).alias("high"), q.alias("spans")))


def _meets(ranges: Column, c: Column, also) -> Column:
    """Whether a span overlaps one of the ranges' spans for which `also` holds; pieces out of reach are passed over."""
    beside = lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]) & also(o)
    return F.exists(ranges, lambda q: (q["low"] < c["end"]) & (c["start"] < q["high"]) & F.exists(q["spans"], beside))


def labelled_sample(rows: int = SAMPLE_ROWS, seed: int = 17) -> list[dict]:
    """Texts with one candidate each and whether it is personal data: invented, seeded, at most `rows`."""
    rng = random.Random(seed)
    pick, word = rng.choice, lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(n: int, good: bool) -> str:
        body = number(n - 1)
        total = sum(int(d) if i % 2 else (2 * int(d) - 9 * (int(d) > 4)) for i, d in enumerate(reversed(body)))
        check = (10 - total % 10) % 10
        whole = body + str(check if good else (check + rng.randint(1, 9)) % 10)
        sign = pick(["", " ", "-"])
        return sign.join((whole[:4], whole[4:10], whole[10:])) if n == 15 else sign.join(whole[i : i + 4] for i in range(0, n, 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"])

    def address(at: str, dot: str) -> str:
        return f"{word()}.{word()}{at}{word()}{dot}{pick(['com', 'org', 'net', 'de', 'fr'])}"

    secret = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789"
    good = (
        lambda: (pick(["mail", "contact", "write to", word()]), address(pick([" [at] ", "(at)", " (at) ", "[at]"]), pick([".", " [dot] ", "(dot)"]))),
        lambda: (pick(["contact", "mail me:", "reach me:"]), address(" at ", pick([" dot ", " dot "]))),
        lambda: (pick(["phone", "call", "tel", "mobile:", "fax", "dial"]), phone()),
        lambda: (pick(["card", "credit card:", "amex", "visa", word()]), card(pick([13, 15, 15, 16]), True)),
        lambda: (word(), f"{pick(['token', 'secret', 'password', 'api_key', 'access_key'])}{pick([' = ', '=', ': '])}\"{secret(alnum, rng.randint(12, 48))}\""),
        lambda: (word(), f"{pick(['token', 'secret', 'api_key'])} = \"{secret('0123456789abcdef', pick([32, 40, 64]))}\""),
        lambda: (pick(["ssn", "social security", "ssn:"]), f"{number(3)}-{number(2)}-{number(4)}"),
        lambda: (pick(["iban", "account", "bank", word()]), f"{pick(['DE', 'FR', 'ES', 'NL'])}{number(2)} {number(4)} {number(4)} {number(4)} {number(4)} {number(2)}"),
    )
    bad = (
        lambda: (pick(["look", "we meet", "arrive", "stay", word()]), f"{word()} at {word()}.{pick(['com', 'the', 'and', 'org'])}"),
        lambda: (pick(["order", "part", "ref", "isbn", "page", word(), word()]), pick([phone(), f"{number(3)} {number(3)} {number(3)}"])),
        lambda: (pick(["order", "invoice", "serial", "item", word(), word()]), card(pick([13, 14, 16, 16]), False)),
        lambda: (word(), f"{pick(['key', 'id', 'value'])}{pick(['=', ': '])}{word()}{word()}xyz"),
        lambda: (pick(["part", "model", "lot", word()]), f"{number(3)}-{number(2)}-{number(4)}"),
        lambda: (pick(["build", "serial", "sku", "part"]), f"{pick(['AB', 'XK', 'QZ'])}{number(2)}{secret('ABCDEFGH0123', 12)}"),
    )
    out = []
    for i in range(rows):
        label = i % 2
        before, body = pick(good if label else bad)()
        lead, tail = f"{word()} {word()}", f" {word()} {word()}"
        # Half of the candidates end a sentence; a full stop within a text would let some of them run on.
        out.append({"text": f"{lead} {before} {body}{tail if i % 4 < 2 else '.'}", "label": label})
    return out


def sample_features(spark: SparkSession, rows: int = SAMPLE_ROWS, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample's candidates, by the same expressions as over documents."""
    texts = json.dumps(labelled_sample(rows, seed)).replace("\\", "\\\\").replace("'", "\\'")
    sample = spark.sql(f"SELECT inline(from_json('{texts}', 'array<struct<text:string,label:int>>'))")
    found = sample.select("label", F.explode(_candidates(F.col("text"))).alias("c")).select("label", *(F.col(f"c.{n}").alias(n) for n in FEATURES))
    got = np.array(sorted(tuple(r) for r in found.collect()), float)
    return got[:, 1:], got[:, 0]


@lru_cache(maxsize=4)
def _fitted(app: str, rows: int) -> Model:
    return fit(*sample_features(SparkSession.active(), rows))


def trained_model(spark: SparkSession, rows: int = SAMPLE_ROWS) -> Model:
    return _fitted(spark.sparkContext.applicationId, rows)


def find_personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Spans of personal data in each row of `docs` (`doc_id`, `text`).

    Valid matches of the four base patterns always stand.  Further candidates come from
    `PROPOSERS`; those stand whose calibrated probability reaches the model's threshold, that overlap
    no base span, and no candidate of higher probability.  Result: doc_id, n_email, n_ip, n_card,
    n_phone (base spans), base_sha256 (of kind:start:end by kind, then start, comma-joined), spans
    (all, joined likewise).  Positions are code points, the end exclusive.

    A null text counts as empty and has no spans; a null doc_id stays null; repeated rows are judged
    each; an empty table gives no rows; other columns are dropped.  A text of any length is searched
    whole; the work for its matches grows a little faster than their number.
    """
    model = model or trained_model(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    for kind, pattern in BASE.items():
        frame = frame.withColumn(kind, _base_spans(kind, pattern))
    frame = frame.withColumn("proposed", _candidates(F.col("text"))).drop("text")
    frame = frame.withColumn("base", F.concat(*(F.array_sort(k) for k in BASE)))
    score = model.sql([f"c.{n}" for n in FEATURES])
    frame = frame.withColumn("scored", F.expr(f"transform(proposed, c -> named_struct('rank', array_position(array({', '.join(map(repr, KINDS))}), c.kind) - 1, 'start', c.start, 'end', c.end, 'p', {score}))"))
    frame = frame.withColumn("likely", _let(_ranges(F.col("base")), lambda near: F.filter("scored", lambda c: (c["p"] >= F.lit(model.threshold)) & ~_meets(near, c, lambda o: F.lit(True)))))
    ahead = lambda o, c: (o["p"] > c["p"]) | (o["p"] == c["p"]) & ((o["start"] < c["start"]) | (o["start"] == c["start"]) & (o["rank"] < c["rank"]))
    frame = frame.withColumn("best", _let(_ranges(F.col("likely")), lambda near: F.filter("likely", lambda c: ~_meets(near, c, lambda o: ahead(o, c)))))
    frame = frame.withColumn("added", F.transform("best", lambda c: F.struct(c["rank"].cast("int").alias("rank"), c["start"].alias("start"), c["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["rank"]), c["start"].cast("string"), c["end"].cast("string"))), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return frame.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat(F.transform("base", lambda c: F.struct(c["rank"].alias("rank"), c["start"].alias("start"), c["end"].alias("end"))), "added"))).alias("spans"))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, f"{sf_dir}/documents.parquet"))
