"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators propose spans with high recall, overlapping ones too: e-mail addresses, IP addresses, card and phone numbers in their
base formats, and looser ones (numbers without a country code, addresses written with "(at)"). Boosted trees score every candidate by
features of its format and context. They are trained on the candidates in base formats, whose own checks label them, from counts per
feature vector; a threshold calibrated on held-out texts selects the spans. Base spans are always kept.

Positions come from splitting a text by a pattern: the lengths of the pieces and of the matches add up to them.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelake.llm.common import only
from tablelake.session import materialise

KINDS = ("email", "ip", "card", "phone")
#: Stands for a dot that ends a domain, in a copy of the text of equal length; that character itself becomes another one.
_DOT, _OTHER = "\ue000", "\ue001"
_LOCAL = r"A-Za-z0-9._%+-"
#: name: (kind, pattern, a text must match this to be looked at). All loops are over single characters, so that no text is too
#: long for the regular expression engine.
GENERATORS = {
    "email": ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++", "@"),
    "ip": ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": ("card", r"[0-9][0-9\x20-]*(?<=[0-9])", r"[0-9][0-9\x20-]{12}"),
    "phone": ("phone", r"\+[0-9][\x20().0-9-]+(?<=[0-9])", r"\+[0-9]"),
    "local": ("phone", r"(?<![0-9+)] ?)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    "spelled": ("email", r"(?i)[A-Z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Z0-9-]{1,63}(?: ?[\[(]dot[\])] ?|\.)[A-Z]{2,24}", r"(?i)[\[(]at[\])]"),
}
BASE = ("email", "ip", "card", "phone")
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_CUES = r"(?i)(tel|phone|call|fax|mobile|mail|contact|card|visa|pay|host|addr|\bip)"
FEATURES = ("kind", "digits", "seps", "plus", "paren", "dots", "luhn", "parts", "cue", "before", "after")
TREES, RATE = 24, 0.4
PRECISION = 0.995
#: One text in so many calibrates the threshold instead of training.
CALIBRATE = 5


# ---- candidates -------------------------------------------------------------
def _running(lengths: Column) -> Column:
    """Running sums of an array, in two levels, so that the work stays near linear in its size."""
    step = 128
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / step).cast("int"))), lambda b: F.slice(lengths, b * step + 1, F.lit(step)))
    add = lambda a, b: a + b
    with_start = F.aggregate(
        blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,own:array<int>>>").alias("out")),
        lambda acc, own: F.struct((acc["at"] + F.aggregate(own, F.lit(0), add)).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("at"), own.alias("own"))).alias("out")))
    return F.flatten(F.transform(with_start["out"], lambda b: F.transform(b["own"], lambda _, i: b["at"] + F.aggregate(F.slice(b["own"], F.lit(1), i + 1), F.lit(0), add))))


def _shape(side: Column, first: bool) -> Column:
    """What a neighbouring character is: 0 none, 1 space, 2 letter or digit, 3 other."""
    c = F.left(side, F.lit(1)) if first else F.right(side, F.lit(1))
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}0-9]"), 2).otherwise(3)


def _candidate(name: str, match: Column, start: Column, before: Column, after: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    kind = GENERATORS[name][0]
    n = F.length(digits)
    valid = {
        "email": F.lit(True), "ip": match.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
        "card": n.between(14, 19) & F.call_function("luhn_check", digits), "phone": n.between(10, 15)}.get(name, F.lit(None).cast("boolean"))
    return F.struct(
        start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(match)).alias("end"), valid.alias("valid"),
        F.least(n, F.lit(20)).alias("digits"), F.least(F.length(F.regexp_replace(match, r"[^\x20-]", "")), F.lit(6)).alias("seps"),
        match.startswith("+").cast("int").alias("plus"), match.contains("(").cast("int").alias("paren"),
        F.least(F.length(F.regexp_replace(match, r"[^.]", "")), F.lit(4)).alias("dots"), F.call_function("luhn_check", digits).cast("int").alias("luhn"),
        match.rlike(rf"^(?:{_PART}\.)+{_PART}$").cast("int").alias("parts"), F.right(before, F.lit(24)).rlike(_CUES).cast("int").alias("cue"),
        _shape(before, False).alias("before"), _shape(after, True).alias("after"))


def _of(name: str):
    return lambda c: _candidate(name, c["m"], c["s"], c["b"], c["a"])


def with_candidates(docs: DataFrame) -> DataFrame:
    """`docs` plus `__pii`, all candidates of `text` in the order of start, kind and end."""
    text = F.coalesce(docs["text"], F.lit(""))
    sources = {
        # Dots that no label follows end a domain: masked, so that a domain is one run of characters.
        "email": F.regexp_replace(F.translate(text, _DOT, _OTHER), r"\.(?![A-Za-z0-9-])", _DOT),
        # Separators next to each other end a number.
        "card": F.regexp_replace(text, r"[\x20-](?=[\x20-])|(?<=[\x20-])[\x20-]", "\n")}
    out = docs
    for name, (_, pattern, trigger) in GENERATORS.items():
        source = F.when(text.contains("@") if trigger == "@" else text.rlike(trigger), sources.get(name, text))
        out = out.withColumn(f"__t_{name}", source)
    out = out.withColumns({f"__m_{n}": F.regexp_extract_all(f"__t_{n}", F.lit(g[1]), F.lit(0)) for n, g in GENERATORS.items()})
    out = out.withColumns({f"__p_{n}": F.when(F.size(f"__m_{n}") > 0, F.split(f"__t_{n}", g[1], -1)) for n, g in GENERATORS.items()})
    out = out.withColumns({f"__g_{n}": F.zip_with(
        F.slice(f"__p_{n}", F.lit(1), F.size(f"__m_{n}")), F.concat(F.array(F.lit("")), F.slice(f"__m_{n}", F.lit(1), F.size(f"__m_{n}") - 1)),
        lambda p, m: F.length(p) + F.length(m)) for n in GENERATORS})
    out = out.withColumns({f"__s_{n}": _running(F.col(f"__g_{n}")) for n in GENERATORS})
    lists = [
        F.coalesce(F.transform(
            F.arrays_zip(F.col(f"__m_{n}").alias("m"), F.col(f"__s_{n}").alias("s"), F.slice(f"__p_{n}", F.lit(1), F.size(f"__m_{n}")).alias("b"), F.slice(f"__p_{n}", F.lit(2), F.size(f"__m_{n}")).alias("a")),
            _of(n)), F.array())
        for n in GENERATORS]
    return out.withColumn("__pii", F.array_sort(F.concat(*lists))).drop(*[f"__{x}_{n}" for x in "tmpgs" for n in GENERATORS])


# ---- boosted trees ----------------------------------------------------------
@dataclass
class Trees:
    """Depth-two trees over small integer features: `(feature, cut, ((feature, cut, low, high), (..)))`; log-odds add up."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    threshold: float = math.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, cut, sides in self.trees:
            for side, (g, c, low, high) in enumerate(sides):
                at = (x[:, f] > cut) == bool(side)
                out[at] += np.where(x[at, g] > c, high, low)
        return out

    def column(self, candidate: Column) -> Column:
        total = F.lit(self.start)
        for f, cut, sides in self.trees:
            leaf = [F.when(candidate[FEATURES[g]] > c, high).otherwise(low) for g, c, low, high in sides]
            total = total + F.when(candidate[FEATURES[f]] > cut, leaf[1]).otherwise(leaf[0])
        return total


def _split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[float, int, int]:
    """Best `(gain, feature, cut)`."""
    best = (0.0, 0, -1)
    whole = grad.sum() ** 2 / (hess.sum() + 1)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            gain = grad[low].sum() ** 2 / (hess[low].sum() + 1) + grad[~low].sum() ** 2 / (hess[~low].sum() + 1) - whole
            if gain > best[0] + 1e-9:
                best = (float(gain), f, int(cut))
    return best


def boost(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> Trees:
    """Logistic boosting over distinct feature vectors with their counts of good and bad candidates."""
    model = Trees(start=float(np.log((good.sum() + 1) / (bad.sum() + 1))))
    if not len(x):
        return model
    odds = np.full(len(x), model.start)
    leaf = lambda at, g, h: float(RATE * g[at].sum() / (h[at].sum() + 1))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        grad, hess = good - (good + bad) * p, (good + bad) * p * (1 - p)
        _, f, cut = _split(x, grad, hess)
        sides = []
        for side in (x[:, f] <= cut, x[:, f] > cut):
            _, g, c = _split(x[side], grad[side], hess[side]) if side.any() else (0, 0, -1)
            low, high = side & (x[:, g] <= c), side & (x[:, g] > c)
            sides.append((g, c, leaf(low, grad, hess), leaf(high, grad, hess)))
        model.trees.append((f, cut, tuple(sides)))
        odds = model.score(x)
    return model


def calibrated(model: Trees, x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> Trees:
    """The least threshold at which held-out candidates are right with PRECISION; at least even odds."""
    if len(x):
        score = model.score(x)
        order = np.argsort(-score, kind="stable")
        right, wrong = np.cumsum(good[order]), np.cumsum(bad[order])
        last = np.append(np.diff(score[order]) != 0, True)
        fine = last & (right >= PRECISION * (right + wrong)) & (right > 0)
        if fine.any():
            model.threshold = max(0.0, float(score[order][fine].min()))
    return model


def held_back(docs: DataFrame) -> Column:
    """Texts that calibrate the threshold."""
    return F.pmod(F.xxhash64(docs["text"]), F.lit(CALIBRATE)) == 0


def fit(found: DataFrame) -> Trees:
    """Trees learned from `held, __pii`, the candidates of all texts (see `with_candidates`), which should be a written table.

    Brought to the driver are counts per feature vector: their number is bounded by the features' ranges, not by the texts.
    """
    rows = found.select("held", F.explode("__pii").alias("c")).where("c.valid IS NOT NULL")
    counts = rows.groupBy("held", *[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(F.sum(F.col("c.valid").cast("long")).alias("good"), F.sum((~F.col("c.valid")).cast("long")).alias("bad"))
    got = np.array(sorted(tuple(int(v) for v in r) for r in counts.collect()), np.int64).reshape(-1, len(FEATURES) + 3)
    held, x, good, bad = got[:, 0] == 1, got[:, 1:-2], got[:, -2].astype(float), got[:, -1].astype(float)
    return calibrated(boost(x[~held], good[~held], bad[~held]), x[held], good[held], bad[held])


# ---- results ----------------------------------------------------------------
def _chosen(found: DataFrame, model: Trees) -> Column:
    """Base spans and those the trees add, each once."""
    passes = lambda c: F.coalesce(c["valid"], F.lit(False)) | (model.column(c) >= F.lit(model.threshold)) if model.threshold < math.inf else F.coalesce(c["valid"], F.lit(False))
    return F.array_sort(F.array_distinct(F.transform(F.filter("__pii", passes), _bare)))


def _bare(c: Column) -> Column:
    return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))


def _is(kind: int):
    return lambda s: s["kind"] == kind


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """Personal data in every row of `docs` (`doc_id`, `text`).

    Returns `doc_id, n_email, n_ip, n_card, n_phone` (base spans), `base_sha256` (of the base spans as `kind:start:end`, comma-joined by start and kind)
    and `spans` (all spans, written likewise). Positions count code points from 0, ends are exclusive. A null or empty text has no spans.
    Repeated rows give equal results; other columns are not read.
    """
    docs = only(docs, "doc_id", "text")
    found = materialise(with_candidates(docs.withColumn("held", held_back(docs))).select("doc_id", "held", "__pii"), "pii-candidates")
    model = model or fit(found)
    base = F.transform(F.filter("__pii", lambda c: F.coalesce(c["valid"], F.lit(False))), _bare)
    out = found.select("doc_id", F.array_sort(base).alias("base"), _chosen(found, model).alias("all"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def redact(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """`docs` with every span of `text` replaced by its kind, as `<EMAIL>`; overlapping spans become one, named after the first.

    `n_chars`, where there is such a column, follows the new text. All rows and columns stay; a null text stays null.
    """
    if model is None:
        texts = only(docs, "text")
        model = fit(materialise(with_candidates(texts.withColumn("held", held_back(texts))).select("held", "__pii"), "pii-candidates"))
    names = docs.columns  # the other columns go by their place meanwhile, so that none clashes with a working column
    docs = docs.toDF(*[c if c in ("text", "n_chars") else f"c{i}" for i, c in enumerate(names)])
    found = with_candidates(docs)
    found = found.withColumn("__pii", _chosen(found, model))
    kind = "array<struct<start:int,kind:int,end:int>>"

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        apart = (F.size(acc) == 0) | (s["start"] >= F.get(acc, F.size(acc) - 1)["end"])
        return F.when(apart, F.array_append(acc, s)).otherwise(F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), wider))

    merged = found.withColumn("__pii", F.aggregate(F.col("__pii").cast(kind), F.array().cast(kind), merge))
    text, spans = F.col("text"), F.col("__pii")
    tag = lambda k: F.element_at(F.array(*[F.lit(f"<{x.upper()}>") for x in KINDS]), k + 1)
    until = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
    parts = F.transform(spans, lambda s, i: F.concat(F.substring(text, until(i) + 1, s["start"] - until(i)), tag(s["kind"])))
    tail = F.substring(text, F.get(spans, F.size(spans) - 1)["end"] + 1, F.length(text))
    new = F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(text)
    out = merged.withColumn("text", new).drop("__pii")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(text.isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns).toDF(*names)
