"""Personal data and secrets: generators, boosted trees, calibrated thresholds.

DataFrame functions only.  Four base kinds are fixed by pattern and check
(email, ip, card, phone).  Further kinds come from high-recall
generators whose proposals may overlap; boosted trees over format and context
features score each proposal, and a threshold per kind, set on calibrated
probabilities, decides.  The trees are fitted on the driver from spans that are
made up by rule (``training_texts``) and become column expressions.
"""

from __future__ import annotations

import json
import random
import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.boosting import Booster, fit, threshold_for

_LOCAL = r"[A-Za-z0-9._%+-]"
#: base kinds in the order of output; possessive and anchored forms of the defining patterns, equal in what they match
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: generators of the further kinds
MORE = {
    "secret": [
        r"(?<=(?i:password|passwd|pwd|token|secret|key)[ ]{0,3}[=:][ ]{0,3}[\x22\x27]?)[^\s\x22\x27=]{6,}+",
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+",
    ],
    "contact": [
        r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])",
        r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++ ?[\[(](?:dot|DOT)[\])] ?[A-Za-z]{2,}+",
    ],
    "identity": [
        r"(?<![0-9.+-])[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4}(?![0-9-])",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?(?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    ],
}
PRECISION = 0.98
_CONTEXT = 28
_SPAN = "array<struct<start:int,stop:int,said:string>>"
_BLOCK = 4096


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` over a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, op: str, start: int, block: int = 128) -> str:
    """SQL: running fold of an int array that isn't empty; ``op`` is over {p} and {q}.

    Long arrays are folded in blocks, so that they cost about n * block.
    """

    def inner(x: str) -> str:
        step = _let(op.format(p="acc.at", q="v"), "t", "named_struct('at', t, 'out', array_append(acc.out, t))")
        return f"aggregate({x}, named_struct('at', {start}, 'out', CAST(array() AS array<int>)), (acc, v) -> {step}, acc -> acc.out)"

    shifted = "transform(x, v -> " + op.format(p="w", q="v") + ")"
    joined = _let(inner("transform(parts, x -> element_at(x, -1))"), "past", f"flatten(transform(parts, (x, i) -> CASE WHEN i = 0 THEN x ELSE {_let('past[i - 1]', 'w', shifted)} END))")
    cut = f"transform(sequence(0, CAST((size(vals) - 1) DIV {block} AS int)), b -> slice(vals, b * {block} + 1, {block}))"
    return _let(values, "vals", f"CASE WHEN size(vals) <= {block} THEN {inner('vals')} ELSE {_let(f'transform({cut}, x -> {inner("x")})', 'parts', joined)} END")


def find_spans(text: str, pattern: str) -> str:
    """SQL: leftmost non-overlapping matches as (start, stop, said), in code points; ``text`` names a column."""
    steps = f"zip_with(slice(split({text}, r'{pattern}', -1), 1, size(found)), found, (g, m) -> length(g) + length(m))"
    placed = f"zip_with({_running(steps, '{p} + {q}', 0)}, found, (e, m) -> named_struct('start', e - length(m), 'stop', e, 'said', m))"
    return _let(f"regexp_extract_all({text}, r'{pattern}', 0)", "found", f"CASE WHEN size(found) > 0 THEN {placed} ELSE CAST(array() AS {_SPAN}) END")


_DIGITS = "regexp_replace(s.said, r'[^0-9]', '')"
_PLACES = "transform(split(reverse(d), ''), (c, i) -> coalesce(try_cast(c AS int), 0) * (1 + i % 2))"
_LUHN = f"aggregate(transform({_PLACES}, v -> CASE WHEN v > 9 THEN v - 9 ELSE v END), 0, (a, v) -> a + v) % 10 = 0"
#: SQL over a match s: the check of each base kind
CHECK = {
    "email": "true",
    "ip": "forall(split(s.said, r'\\.'), o -> " + _let("ltrim('0', o)", "z", "length(z) <= 3 AND coalesce(try_cast(z AS int), 0) <= 255") + ")",
    "card": _let(_DIGITS, "d", f"CASE WHEN length(d) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END"),
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}


_CODE = "concat(substring(replace(said, ' ', ''), 5), substring(said, 1, 4))"
_REST = f"aggregate(split({_CODE}, ''), 0, (a, c) -> CASE WHEN c = '' THEN a WHEN c <= '9' THEN (a * 10 + CAST(c AS int)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)"
#: SQL over ``said``: an account number whose check digits hold (remainder 1 by 97 with the first four signs last, letters from 10)
_CHECKED = f"CAST(CASE WHEN said RLIKE r'^[A-Z]{{2}}[0-9]{{2}}[ A-Z0-9]{{8,40}}$' THEN {_REST} = 1 ELSE false END AS double)"


def _features(generator: int) -> str:
    """SQL: features of a proposal from its text ``said`` and the text before it, ``near``."""
    count = lambda p: f"CAST(regexp_count(said, r'{p}') AS double)"
    before = lambda p: f"CAST(near RLIKE r'{p}' AS double)"
    n = "CAST(length(said) AS double)"
    return "array(" + ", ".join(
        [
            n,
            f"{count('[0-9]')} / {n}",
            f"{count('[A-Z]')} / {n}",
            f"size(array_distinct(split(said, ''))) / {n}",
            f"{count('(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]')} / {n}",
            before(r"(password|passwd|pwd|token|secret|key|auth)[^a-z]{0,6}$"),
            before(r"[=:]\s{0,3}[\x22\x27]?$"),
            before(r"\b(phone|tel|call|fax|mobile|contact|reach|mail|write)\b"),
            before(r"\b(ssn|social|tax|passport|iban|account|insurance|license)\b"),
            f"{generator}D",
            f"{count('[^A-Za-z0-9]')} / {n}",
            "CAST(said RLIKE r'^[0-9a-f]+$' AS double)",
            _CHECKED,
        ]
    ) + ")"


def _proposals(text: str) -> str:
    """SQL: the proposals of all generators as (rank, start, stop, x), x being the features."""
    parts, g = [], 0
    for rank, patterns in enumerate(MORE.values(), len(BASE)):
        for p in patterns:
            near = f"lower(substring({text}, greatest(1, s.start + 1 - {_CONTEXT}), least(s.start, {_CONTEXT})))"
            x = _let("s.said", "said", _let(near, "near", _features(g)))
            parts.append(f"transform({find_spans(text, p)}, s -> named_struct('rank', {rank}, 'start', s.start, 'stop', s.stop, 'x', {x}))")
            g += 1
    return f"flatten(array({', '.join(parts)}))"


def account_number(r: random.Random, length: int, spaced: bool) -> str:
    """A made-up account number of ``length`` signs whose check digits hold."""
    land, body = "".join(r.choices(string.ascii_uppercase, k=2)), "".join(r.choices(string.digits, k=length - 4))
    if r.random() < 0.4:
        body = "".join(r.choices(string.ascii_uppercase, k=4)) + body[4:]
    rest = int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
    said = f"{land}{98 - rest:02d}{body}"
    return " ".join(said[i : i + 4] for i in range(0, length, 4)) if spaced else said


def training_texts(n: int = 3000, seed: int = 11) -> list[dict]:
    """Made-up texts with one span each: (text, start, stop, y).  ``n`` bounds the training."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    low, up, num, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    word = lambda: pick(low, r.randint(2, 9))
    plain = lambda: " ".join(word() for _ in range(r.randint(2, 5))) + " "
    named = lambda *names: plain() + r.choice(names) + r.choice([" = ", "=", ": ", ' = "'])
    good = [
        lambda: (named("password", "passwd", "pwd"), pick(hexa, r.randint(8, 20))),
        lambda: (named("token", "secret", "api_key"), pick(hexa, r.choice([32, 40, 64]))),
        lambda: (named("key", "secret"), pick(low + up + num, r.randint(20, 40))),
        lambda: (plain(), r.choice(["AKIA", "ASIA", "ghp_", "xoxb-"]) + pick(up + num, 16)),
        lambda: (plain(), pick(low + up + num + "+/", r.randint(32, 44))),
        lambda: (plain() + r.choice(["call ", "phone: ", "tel "]), f"({pick(num, 3)}) {pick(num, 3)}-{pick(num, 4)}"),
        lambda: (plain() + r.choice(["mobile ", "contact ", "fax: "]), f"{pick(num, 3)}-{pick(num, 3)}-{pick(num, 4)}"),
        lambda: (plain(), f"{word()}x{pick(num, 2)} [at] {word()} [dot] com"),
        lambda: (plain() + r.choice(["ssn ", "social: ", "tax id "]), f"{pick(num, 3)}-{pick(num, 2)}-{pick(num, 4)}"),
        lambda: (plain() + r.choice(["iban ", "account "]), pick(up, 2) + pick(num, 2) + "".join(" " + pick(num, 4) for _ in range(4))),
        lambda: (plain(), pick(low + up + "+/", r.randint(14, 24)) + pick(num, 1) + pick(low + up + "+/", r.randint(14, 20))),
        lambda: (plain(), account_number(r, r.randint(15, 31), r.random() < 0.6)),
        lambda: (plain() + r.choice(["iban: ", "account number ", "account no. ", "iban "]), account_number(r, r.randint(15, 31), r.random() < 0.6)),
        lambda: (plain() + r.choice(["ssn ", "ssn: ", "social security number ", "social security no. ", "tax id: "]), pick(num, 9) if r.random() < 0.6 else f"{pick(num, 3)} {pick(num, 2)} {pick(num, 4)}"),
    ]
    bad = [
        lambda: (named("key", "token"), word() + pick(low, 8)),
        lambda: (plain(), "-".join(word() for _ in range(4)) + "-" + pick(num, 1)),
        lambda: (plain(), "/".join(word() for _ in range(4)) + "/" + pick(num, 4)),
        lambda: (plain(), pick(low, r.randint(14, 24)) + pick(num, 1)),
        lambda: (plain(), "".join(word().title() for _ in range(r.randint(3, 5))) + pick(num, 1)),
        lambda: (plain(), pick(num, r.randint(16, 24))),
        lambda: (plain(), f"20{pick(num, 2)}-0{pick('123456789', 1)}-{pick('012', 1)}{pick(num, 1)}-{pick(num, 6)}"),
        lambda: (plain() + r.choice(["lot ", "part ", "issue "]), f"{pick(num, 3)}-{pick(num, 3)}-{pick(num, 4)}"),
        lambda: (plain() + r.choice(["row ", "code "]), f"{pick(num, 3)}-{pick(num, 2)}-{pick(num, 4)}"),
        lambda: (plain() + r.choice(["order ", "invoice no. ", "ticket ", ""]), pick(num, 9) if r.random() < 0.6 else f"{pick(num, 3)} {pick(num, 2)} {pick(num, 4)}"),
        lambda: (plain() + r.choice(["model ", "serial ", ""]), pick(up, 2) + pick(num, r.randint(12, 24))),
        lambda: (plain() + r.choice(["order ", "batch ", ""]), pick(up, 2) + pick(num, 2) + "".join(" " + pick(num, 4) for _ in range(r.randint(3, 6)))),
        lambda: (plain() + r.choice(["model ", "section "]), pick(up, 2) + pick(num, 2) + " " + " ".join(pick(up, 4) for _ in range(4))),
    ]
    out = []
    for i in range(n):
        y = i % 2
        before, said = r.choice(good if y else bad)()
        out.append({"text": before + said + " " + plain(), "start": len(before), "stop": len(before) + len(said), "y": y})
    return out


def train(spark: SparkSession, n: int = 3000, seed: int = 11) -> tuple[Booster, dict[str, float]]:
    """(trees, threshold of each kind), from ``n`` made-up texts whose features Spark computes.

    Three texts of five grow the trees, the fourth calibrates, the fifth sets thresholds.
    """
    told = F.from_json(F.lit(json.dumps(training_texts(n, seed))), "array<struct<text:string,start:int,stop:int,y:int>>")
    rows = spark.range(1).select(F.posexplode(told).alias("i", "t")).select("i", "t.*")

    found = rows.select("i", "start", "stop", "y", F.explode(F.expr(_proposals("text"))).alias("c"))
    got = found.select("i", "c.rank", "c.x", ((F.col("y") == 1) & (F.col("c.start") < F.col("stop")) & (F.col("c.stop") > F.col("start"))).alias("y")).orderBy("i", "rank", "x").collect()
    x, y, ranks = np.array([g["x"] for g in got], float), np.array([g["y"] for g in got]), np.array([g["rank"] for g in got])
    part = np.array([g["i"] for g in got]) % 5
    model = fit(x[part < 4], y[part < 4], part[part < 4] == 3)
    p = model.scores(x)
    own = lambda r: (part == 4) & (ranks == r)
    return model, {k: threshold_for(p[own(r)], y[own(r)], PRECISION) for r, k in enumerate(MORE, len(BASE))}


def detect(docs: DataFrame, model: tuple[Booster, dict[str, float]] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, stop), in code points, stop exclusive.

    Base spans: leftmost non-overlapping matches per kind that pass the kind's
    check; a failing match is dropped without another try.  ``spans`` holds
    them and the accepted proposals that don't lie inside another
    span.  Both are ordered by kind (base kinds first), then start.

    A null or empty text has none.  Repeated and null keys don't matter, as
    each row stands alone; input columns named base or spans give way.
    Texts without any digit, "@", bracket or equals sign hold nothing that the
    patterns can match and are only scanned for these.
    """
    trees, limits = model or train(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    out = plain.withColumn("body", F.coalesce(f"c{kept.index(text)}", F.lit("")))
    none = "CAST(array() AS array<struct<rank:int,start:int,stop:int>>)"
    slim = lambda spans, rank: f"transform({spans}, s -> named_struct('rank', {rank}, 'start', s.start, 'stop', s.stop))"
    need = {"email": "contains(body, '@')", "phone": "contains(body, '+')"}
    base = [f"CASE WHEN {need.get(k, 'true')} THEN {slim(f'filter({find_spans("body", p)}, s -> {CHECK[k]})', r)} ELSE {none} END" for r, (k, p) in enumerate(BASE.items())]
    limit = "element_at(array(" + ", ".join(f"{limits[k]!r}D" for k in MORE) + f"), s.rank - {len(BASE) - 1})"
    likely = f"filter(more, s -> {trees.probability(lambda f: f's.x[{f}]')} >= {limit})"
    some = r"body RLIKE r'[0-9@\[(=:]'"
    out = out.withColumn("base", F.expr(f"CASE WHEN {some} THEN flatten(array({', '.join(base)})) ELSE {none} END"))
    out = out.withColumn("more", F.expr(f"CASE WHEN {some} THEN {_proposals('body')} END"))
    out = out.withColumn("more", F.expr(f"CASE WHEN size(more) > 0 THEN array_distinct({slim(likely, 's.rank')}) END"))
    # an accepted proposal inside another span adds nothing: by start, then widest, no earlier stop may reach its own
    wide = "array_sort(transform(concat(base, more), s -> named_struct('start', s.start, 'minus', -s.stop, 'rank', s.rank)))"
    out = out.withColumn("wide", F.expr(f"CASE WHEN size(more) > 0 THEN {wide} END"))
    out = out.withColumn("reach", F.expr(f"CASE WHEN wide IS NOT NULL THEN {_running('transform(wide, s -> -s.minus)', 'greatest({p}, {q})', -1)} END"))
    alone = f"filter(transform(wide, (s, i) -> named_struct('rank', s.rank, 'start', s.start, 'stop', -s.minus, 'past', CASE WHEN i = 0 THEN -1 ELSE reach[i - 1] END)), s -> s.rank < {len(BASE)} OR s.past < s.stop)"
    out = out.withColumn("spans", F.expr(f"CASE WHEN wide IS NOT NULL THEN {slim(alone, 's.rank')} ELSE base END"))
    names = "array(" + ", ".join(f"'{k}'" for k in [*BASE, *MORE]) + ")"
    show = lambda c: F.expr(f"transform(array_sort({c}), s -> named_struct('kind', {names}[s.rank], 'start', s.start, 'stop', s.stop))").alias(c)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), show("base"), show("spans"))


def _piece(start: str, stop: str) -> str:
    """SQL: code points ``start`` to ``stop`` of a text that is cut into ``blocks``; costs the piece and two blocks."""
    at = lambda v: f"CAST(({v}) DIV {_BLOCK} AS int)"
    block = lambda v: f"coalesce(get(blocks, {at(v)}), '')"
    one = f"substring({block(start)}, ({start}) % {_BLOCK} + 1, ({stop}) - ({start}))"
    more = f"concat(substring({block(start)}, ({start}) % {_BLOCK} + 1), array_join(slice(blocks, {at(start)} + 2, greatest(0, {at(stop)} - {at(start)} - 1)), ''), substring({block(stop)}, 1, ({stop}) % {_BLOCK}))"
    return f"CASE WHEN {at(start)} = {at(stop)} THEN {one} ELSE {more} END"


def redact(detected: DataFrame, text: str = "text") -> DataFrame:
    """``detected`` (from detect) with each span replaced by its kind in brackets; overlapping spans go as one, under the first one's kind.

    The text is cut into blocks once, so the cost is that of the text and the number of spans, not their product.
    """
    names = detected.columns
    out = detected.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    body, spans = f"c{names.index(text)}", f"c{names.index('spans')}"
    some = f"size({spans}) > 0"
    out = out.withColumn("placed", F.expr(f"CASE WHEN {some} THEN array_sort(transform({spans}, s -> named_struct('start', s.start, 'stop', s.stop, 'kind', s.kind))) END"))
    out = out.withColumn("reach", F.expr(f"CASE WHEN {some} THEN {_running('transform(placed, s -> s.stop)', 'greatest({p}, {q})', -1)} END"))
    out = out.withColumn("blocks", F.expr(f"CASE WHEN {some} THEN regexp_extract_all({body}, r'(?s).{{1,{_BLOCK}}}', 0) END"))
    heads = "filter(transform(placed, (s, i) -> named_struct('start', s.start, 'past', CASE WHEN i = 0 THEN 0 ELSE reach[i - 1] END, 'kind', s.kind)), s -> s.past <= s.start)"
    shown = f"array_join(transform({heads}, s -> concat({_piece('s.past', 's.start')}, '[', s.kind, ']')), '')"
    done = f"CASE WHEN {some} THEN concat({shown}, {_piece('element_at(reach, -1)', f'length({body})')}) ELSE {body} END"
    return out.select(*((F.expr(done) if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)))
