"""Personal data by weak supervision.

Fixed patterns give base spans. Wider patterns give candidates, on which
labelers vote: a pattern labeler (how the span is written), gazetteers
(top-level domains, card issuers, calling codes, reserved networks), context
words and checks of form. Whether a span is a base span is no vote and no
feature: it could only teach the base patterns over again. Vote patterns
are counted over all documents; expectation-maximisation on these counts (Dawid
and Skene, 1979) estimates how reliable each labeler is and how likely each
pattern means personal data. With those probabilities as soft labels a logistic
classifier over votes and shape is trained, on counts as well, and it accepts or
refuses the candidates. Only tables of counts, bounded by the number of vote and
shape patterns, ever reach the driver.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import rows_of, ship, table

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: Candidates are accepted from this probability on.
ACCEPT = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# the same matches as without the guard and the possessive runs: a match ends with a whole run of digits, so the next starts at one
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# wider patterns, for candidates
_WIDE = {
    "email": re.compile(r"(?<![\w.%+-])[\w%+-]{1,64}(?:\.[\w%+-]{1,64}){0,4} ?(?:@|[(\[{] ?at ?[)\]}]) ?[\w-]{1,63}(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?[\w-]{2,63}){1,4}(?![\w@])", re.I),
    "ip": re.compile(r"(?<![\w.])[0-9]{1,3}(?: ?(?:\.|\[\.\]|[(\[] ?dot ?[)\]]) ?[0-9]{1,3}){3}(?![\w.][0-9]|\w)", re.I),
    "card": re.compile(r"(?<![\w+.-])[0-9](?:[\x20. ‐-–-]?[0-9]){12,18}(?![\w-]|\.[0-9])"),
    "phone": re.compile(r"(?<![\w+.-])(?:\+|00)?(?:[0-9]{1,3}[\x20./ ‐-–-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./ ‐-–-][0-9]{3,4}[\x20./ ‐-–-][0-9]{3,4}(?![\w-]|\.[0-9])"),
}
_BRACKET = re.compile(r"[(\[{] ?at ?[)\]}]", re.I)
_PLAIN_EMAIL = re.compile(r"[^\s@]+@[^\s@]+")
_CARD_GROUPS = re.compile(r"[0-9]{4}(?:[\x20. -]?[0-9]{4}){2,3}[0-9]{0,3}|[0-9]{4}[\x20. -]?[0-9]{6}[\x20. -]?[0-9]{4,5}|[0-9]{13,19}")
_DASHED = re.compile(r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./ ][0-9]{2,4}[-./ ][0-9]{2,4}")

#: Gazetteers and context words. Fixed values.
DOMAINS = frozenset(
    """com org net edu gov mil int info biz name pro io co me tv cc app dev ai tech online store site shop blog cloud email news
    ad ae al am ar at au az ba bd be bg bo br by ca ch ci cl cm cn cr cu cy cz de dk do dz ec ee eg es et eu fi fr ge gh gr gt hk hn hr
    hu id ie il in iq ir is it jm jo jp ke kr kw kz lb li lk lt lu lv ly ma md mg mk mn mt mu mx my mz na ng ni nl no np nz om pa pe ph
    pk pl pt py qa ro rs ru rw sa se sg si sk sn sv sy th tn tr tt tw tz ua ug uk us uy uz ve vn ye za zm zw""".split()
)
ISSUERS = tuple("4 51 52 53 54 55 22 23 24 25 26 27 34 37 36 38 30 6011 64 65 62 35 50 56 57 58 67".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CUES = {
    "email": frozenset("email e-mail mail contact write reach correo courriel kontakt schreiben adresse escribe contacto contactez écrivez".split()),
    "ip": frozenset("ip ipv4 host server address login adresse dirección gateway router dns subnet client servidor serveur anfrage from".split()),
    "card": frozenset("card visa mastercard amex discover maestro credit debit payment paid pay karte kreditkarte carte bancaire tarjeta crédito zahlung paiement pago".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax whatsapp sms telefon handy anrufen teléfono llame móvil téléphone appelez portable".split()),
}
CONTEXT_CHARS = 40


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the fixed patterns of each kind, leftmost and not overlapping within a kind."""
    found: dict[str, list] = {k: [] for k in KINDS}
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found["email"].append((start, m.end()))
            end = after = m.end()
        at = text.find("@", after)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_part_ok, m.group().split(".")))]
        found["card"] = [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]
    shape: tuple[int, ...]


def _vote(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def _label(kind: str, text: str, start: int, end: int) -> Candidate:
    """Votes (pattern, gazetteer, context, shape; 1 for, -1 against, 0 abstains) and shape features of a candidate."""
    span = text[start:end]
    digits = _digits(span)
    around = text[max(0, start - CONTEXT_CHARS) : start].lower()
    words = set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", around))
    before = text[start - 1] if start else " "
    after = text[end] if end < len(text) else " "
    context = _vote(bool(words & CUES[kind]), bool(re.search(r"(?:version|release|isbn|order|serial|token|key|hash|id)\W*$", around)))
    glued = before.isalnum() or after.isalnum() or before in "=/#_"
    if kind == "email":
        written = _vote(_PLAIN_EMAIL.fullmatch(span) is not None or _BRACKET.search(span) is not None)
        last = re.split(r"[.\s)\]}]+", span.rstrip(")]}").lower())[-1]
        gazetteer = _vote(last in DOMAINS, not last.isalpha())
        form = _vote("@" in span and " " not in span, " " in span and "@" in span)
    elif kind == "ip":
        written = _vote("[" in span or "(" in span or " " not in span, ". " in span or " ." in span)
        parts = _DIGIT.sub("0", span) and re.findall(r"[0-9]+", span)
        first = int(parts[0][:4])
        gazetteer = _vote(1 <= first <= 223 and first != 127, first == 0 or first > 239)
        form = _vote(all(map(_part_ok, parts)) and all(p == "0" or p[0] != "0" for p in parts), not all(map(_part_ok, parts)))
    elif kind == "card":
        # in groups as on the card, or in one
        written = _vote(_CARD_GROUPS.fullmatch(span) is not None)
        gazetteer = _vote(digits.startswith(ISSUERS), digits[0] in "01789")
        form = _vote(luhn(digits), not luhn(digits))
    else:
        written = _vote(span.startswith(("+", "00", "(")) or _DASHED.fullmatch(span) is not None, _DATE.fullmatch(span) is not None)
        international = span.startswith(("+", "00"))
        code = digits[2:] if span.startswith("00") else digits
        known = any(code[:n] in CALLING for n in (1, 2)) if international else len(digits) in (10, 11) and digits[-10] in "23456789"
        gazetteer = _vote(known, len(digits) < 8 or len(digits) > 15)
        form = _vote(8 <= len(digits) <= 15 and ("(" in span) == (")" in span), luhn(digits) and len(digits) > 12)
    votes = (written, gazetteer, context, form)
    shape = (int(glued), int(" " in span), min(3, len(digits) // 5), int(not span.isascii()))
    return Candidate(kind, start, end, votes, shape)


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[Candidate]:
    """Base spans and all other spans of the wider patterns that overlap no base span."""
    out = [_label(k, text, a, b) for k in KINDS for a, b in base[k]]
    starts, ends = [], []  # of stretches of base spans, which do not overlap each other
    for a, b in sorted(s for k in KINDS for s in base[k]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    wide = []
    if "@" in text or _BRACKET.search(text):
        wide.append("email")
    if _DIGIT.search(text):
        wide += KINDS[1:]
    for kind in wide:
        for m in _WIDE[kind].finditer(text):
            before = bisect_left(starts, m.end()) - 1
            if before < 0 or ends[before] <= m.start():
                out.append(_label(kind, text, *m.span()))
    return out


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Dawid-Skene for two classes on counted vote patterns -> probability of each pattern, and the labelers' vote distributions.

    Every labeler has, for each class, a distribution over its votes -1, 0 and 1. The start is the share of votes in favour.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, np.empty((2, 0, 3))
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array(patterns) + 1
    p = np.clip((votes - 1).mean(axis=1) / 2 + 0.5, 0.05, 0.95)
    weight = np.stack([1 - p, p])
    table_ = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        prior = (weight * n).sum(axis=1) + 1
        for c in (0, 1):
            for j in range(votes.shape[1]):
                # smoothed towards the vote that fits the class, which keeps class 1 the personal one
                table_[c, j] = np.bincount(votes[:, j], weight[c] * n, 3) + ((1, 1, 2) if c else (2, 1, 1))
        table_ /= table_.sum(axis=2, keepdims=True)
        logs = np.log(prior / prior.sum())[:, None] + sum(np.log(table_[:, j, :][:, votes[:, j]]) for j in range(votes.shape[1]))
        weight = np.exp(logs - logs.max(axis=0))
        weight /= weight.sum(axis=0)
    return dict(zip(patterns, weight[1].tolist(), strict=True)), table_


def _features(votes: tuple, shape: tuple) -> list[float]:
    return [1.0, *[float(v == s) for v in votes for s in (-1, 1)], *map(float, shape)]


def train(counts: dict[tuple[str, tuple, tuple], int], rounds: int = 300) -> dict[str, np.ndarray]:
    """Weights of one logistic classifier for each kind, from counts of (kind, votes, shape) and the estimated labels."""
    weights = {}
    for kind in KINDS:
        own = {(v, s): n for (k, v, s), n in counts.items() if k == kind}
        by_votes: Counter = Counter()
        for (v, _), n in own.items():
            by_votes[v] += n
        likely, _ = estimate(by_votes)
        keys = sorted(own)
        if not keys:
            continue
        x = np.array([_features(*k) for k in keys])
        y = np.array([likely[k[0]] for k in keys])
        n = np.array([own[k] for k in keys], float)
        w, total = np.zeros(x.shape[1]), n.sum()
        for _ in range(rounds):  # Newton steps with a ridge of one observation
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (n * (p - y)) + w
            hessian = (x.T * (n * p * (1 - p) + 1e-9)) @ x + np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-9 * max(1.0, total):
                break
        weights[kind] = w
    return weights


def accepted(c: Candidate, weights: dict[str, np.ndarray]) -> bool:
    w = weights.get(c.kind)
    return w is not None and 1 / (1 + np.exp(-float(np.dot(w, _features(c.votes, c.shape))))) >= ACCEPT


def find(text: str, weights: dict[str, np.ndarray]) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, all spans) by kind. Base spans stay; candidates outside them are judged by the classifier."""
    base = base_spans(text)
    every = {k: list(base[k]) for k in KINDS}
    own = {(k, *s) for k in KINDS for s in base[k]}
    for c in candidates(text, base):
        if (c.kind, c.start, c.end) not in own and accepted(c, weights):
            every[c.kind].append((c.start, c.end))
    return base, {k: sorted(v) for k, v in every.items()}


def learn(docs: DataFrame, text: str = "text") -> dict[str, np.ndarray]:
    """Count votes and shapes over all documents, then fit. The counts are summed in the tasks and then by Spark."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for (value,) in rows_of(batch, "t"):
                if value:
                    seen.update((c.kind, c.votes, c.shape) for c in candidates(value, base_spans(value)))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([list(k[1]) for k in keys], pa.list_(pa.int32())), pa.array([list(k[2]) for k in keys], pa.list_(pa.int32())), pa.array([seen[k] for k in keys], pa.int64())], ["kind", "votes", "shape", "n"])

    rows = docs.select(docs[text].alias("t")).mapInArrow(count, "kind string, votes array<int>, shape array<int>, n bigint")
    total = rows.groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n")).collect()
    return train({(r["kind"], tuple(r["votes"]), tuple(r["shape"])): r["n"] for r in total})


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """Each span gives way to its kind in brackets; where spans overlap, the whole stretch goes under the first kind."""
    out, at = [], 0
    marks = sorted((a, b, k) for k in KINDS for a, b in spans[k])
    k = 0
    while k < len(marks):
        a, b, kind = marks[k]
        k += 1
        while k < len(marks) and marks[k][0] < b:
            b = max(b, marks[k][1])
            k += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def spans(docs: DataFrame, weights: dict[str, np.ndarray] | None = None, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """identifier, n_email, n_ip, n_card, n_phone (base), base_sha256, spans: one row for each row; null is the empty text.

    ``weights`` come from ``learn``, by default on these documents. There is no shuffle of documents. Texts may be of any length;
    repeated rows repeat; an empty table gives an empty table; other columns, whatever their names, are not looked at.
    """
    ship(docs.sparkSession)
    weights = learn(docs, text) if weights is None else weights
    kind = docs.schema[identifier].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for (value,) in rows_of(batch, "t"):
                base, every = find(value or "", weights)
                rows.append((*[len(base[k]) for k in KINDS], hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]], [identifier, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select(docs[identifier].alias("i"), docs[text].alias("t")).mapInArrow(run, f"`{identifier}` {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, spans in ``text`` replaced by their kind; ``n_chars`` follows where it is a column.

    Null texts stay null, empty ones empty; an empty table gives an empty table. Texts of any length are read and rewritten whole, a
    row at a time; repeated rows stay and are changed alike; columns keep their names, whatever these are.
    """
    ship(docs.sparkSession)
    weights = learn(docs, text)
    names = docs.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if v is None else redacted(v, find(v, weights)[1]) for (v,) in rows_of(batch, text)]
            columns = [pa.array(new, pa.string()) if n == text else c for n, c in zip(names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
