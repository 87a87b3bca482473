"""Personal data: base patterns, and a span classifier trained by weak supervision.

Every place that looks like an address, a number, a credential or a name is a candidate. Labelers vote
on it (1: personal data, 0: not, no vote): a strict pattern, a gazetteer, the words before it, its
form, and what speaks against it. The votes of all candidates of the corpus are counted by pattern of
votes and form; the number of patterns is bounded by the labelers, not by the corpus.
Expectation-maximisation over these counts estimates how reliable each labeler is, per kind, and how
likely each candidate is personal data. A logistic span classifier is then trained on these
probabilities over votes and form, and decides on every candidate that no base pattern covers. Base
spans always stay; spans of the kinds ``secret`` (a credential) and ``name`` come from it alone.

Defined results: a null or empty text has no spans; very long texts are searched whole, in time linear
in their length; of candidates that overlap the one that starts first counts, then the longer, then
the kind listed first; candidates that reach into a base span are left out; equal rows get equal
results, one for each; an empty corpus trains nothing, and then only base spans are found; columns
with the names of new ones are replaced, all others stay.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "name")
_NUMBER = {k: i for i, k in enumerate(KINDS)}

# The base patterns. Those that start at a digit start at the first of a run of digits:
# no later start in a run can match where the first one doesn't.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Candidates that are wider than the base patterns.
_RUN = re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9])++")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?(?:at|AT|At|@) ?[\])] ?[A-Za-z0-9-]++(?:(?: ?[\[(] ?(?:dot|DOT|Dot|\.) ?[\])] ?|\.)[A-Za-z0-9-]++)+")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_ASSIGNED = re.compile(r"[=:] ?[\"']?([^\s\"'<>,;=]{8,}+)")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
_TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Dear|Herr|Frau|Monsieur|Madame|Señor|Señora|[Nn]ame is|[Nn]ame:)\.? ((?:[A-ZÀ-Þ][a-zß-ÿ'-]++ ?)++)")

# Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co us uk de fr es it nl eu ch at be se no dk fi pl pt ru cn jp in br ca au example test".split())
CARD_ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "65", "22", "23", "24", "25", "26", "27")
DIAL_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 94 98".split())
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write to|courriel|correo)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|ipv6|host|server|address|login)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|credit|debit|payment|carte|tarjeta|karte)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|fax|mobile|cell|whatsapp|telefon|téléphone|teléfono)\b"),
    "secret": re.compile(r"(?i)(?:\b|_)(?:token|secret|password|passwd|passphrase|pwd|api|key|auth|bearer|credentials?|login)(?:\b|_)"),
    "name": re.compile(r"(?i)\b(?:sincerely|regards|signed|contact|author|patient|customer|client|dear|met|with|by)\b"),
}
AGAINST = re.compile(r"(?i)\b(?:isbn|issn|doi|version|order|invoice|page|pages|chapter|figure|total|sum|commit|sha|sha1|sha256|md5|checksum|digest|uuid|build|http|https|url|street|square)\b")
CREDENTIALS = frozenset("token secret password passwd passphrase pwd key apikey auth bearer credential credentials".split())
GIVEN_NAMES = frozenset("James Mary John Anna Maria Peter Paul Robert Linda David Sarah Michael Laura Thomas Emma Daniel Sophie Jean Pierre Marie Claire Hans Klaus Karl Heinz Ursula Petra Jan Eva José Juan Carlos Luis Ana Carmen Elena Marco Giulia Ivan Olga Natasha Ahmed Fatima Wei Li".split())
CONTEXT_CHARS = 32

#: "against" votes 0 or not at all; the others may disagree with each other on any candidate.
LABELERS = ("pattern", "gazetteer", "context", "form", "against")
#: How often each is taken to be right before anything is known, with the weight of five votes.
TRUST = (0.8, 0.8, 0.8, 0.8, 0.95)
EM_ROUNDS = 100
THRESHOLD = 0.5


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base patterns: leftmost, not overlapping, per kind."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:  # each @ once; the local part reaches back to the end of the match before at most
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _others(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, -end) of places wider than the base patterns."""
    if "(" in text or "[" in text:
        for m in _SPELT.finditer(text):
            yield m.start(), 0, -m.end()
    if text.count(":") >= 7:
        for m in _IP6.finditer(text):
            yield m.start(), 1, -m.end()
    for m in _RUN.finditer(text):
        if m.end() - m.start() >= 7 and (n := len(_digits(m[0]))) >= 7:
            yield m.start(), 2 if n >= 13 else 1 if m[0].count(".") == 3 else 3, -m.end()
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            yield m.start(1), 4, -m.end(1)
    for m in _OPAQUE.finditer(text):
        s = m[0]
        if not s.isalpha() and not s.isdigit() and _letters(s):
            yield m.start(), 4, -m.end()
    for m in _TITLED.finditer(text):
        yield m.start(1), 5, -(m.start(1) + len(m[1].rstrip()))


def _letters(s: str) -> bool:
    return any("a" <= c <= "z" or "A" <= c <= "Z" for c in s)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, str]]:
    """Spans that may be personal data (the base ones among them), with their pattern of votes and form."""
    for start, kind, end in base:
        yield start, kind, end, _votes(text, start, kind, end, True)
    taken = _merged([(s, e) for s, _, e in base])
    k, done = 0, 0
    for start, end, kind in sorted((s, e, k) for s, k, e in set(_others(text))):  # the longer first, as ends are negative
        end = -end
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if start >= done and (k == len(taken) or end <= taken[k][0]):
            done = end
            yield start, kind, end, _votes(text, start, kind, end, False)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _varied(s: str) -> bool:
    """Whether the characters of ``s`` are as mixed as in random text: few repeats, in letters and digits."""
    return len(set(s)) >= min(9, len(s) // 2 + 1) and not s.isalpha() and _letters(s)


def _votes(text: str, start: int, kind: int, end: int, strict: bool) -> str:
    """The votes (1, 0, or - for none) and the form of a candidate, as one short string."""
    s = text[start:end]
    d = _digits(s)
    before = text[max(0, start - CONTEXT_CHARS):start]
    if kind == 0:
        known = "1" if re.split(r"[^A-Za-z0-9-]+", s)[-1].lower() in TOP_DOMAINS else "0"
        form = "1" if _letters(s) else "0"
    elif kind == 1:
        known = "0" if d.startswith(("0", "127")) else "-"
        form = "1" if ":" in s or all(len(p) <= 3 and p and int(p) <= 255 for p in re.split(r"[^0-9]+", s) if p) and s.count(".") == 3 else "0"
    elif kind == 2:
        known = "1" if d.startswith(CARD_ISSUERS) else "0"
        form = "1" if luhn(d) else "0"
    elif kind == 3:
        plus = s.startswith("+")
        known = ("1" if d[:1] in DIAL_CODES or d[:2] in DIAL_CODES else "0") if plus else "-"
        form = "1" if re.fullmatch(r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})*", s) else "0"
    elif kind == 4:
        words = re.findall(r"[A-Za-z]+", before)
        assigned = re.search(r"[=:] ?[\"']?$", before)
        known = ("1" if words[-1].lower() in CREDENTIALS else "0") if assigned and words else "-"
        strict = bool(re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", s)) or len(s) >= 20 and bool(re.search(r"[0-9]", s) and re.search(r"[a-z]", s) and re.search(r"[A-Z]", s) and not re.search(r"[^A-Za-z0-9+/_-]", s))
        form = "1" if _varied(s) else "0"
    else:
        words = s.split()
        known = "1" if words[0] in GIVEN_NAMES else "0"
        strict = len(words) in (2, 3)
        form = "1" if all(2 <= len(w) <= 15 for w in words) else "0"
    # without words before it a number may still be one; a random string or a name tells little by itself
    context = "1" if CONTEXT[KINDS[kind]].search(before) else "-" if kind < len(BASE_KINDS) else "0"
    against = "0" if AGAINST.search(before) or s.startswith(("/", "http")) else "-"
    parts = min(4, len(re.split(r"[^0-9A-Za-z]+", s.strip("+("))))
    return f"{KINDS[kind]}|{'1' if strict else '0'}{known}{context}{form}{against}|{min(len(d), 24)}|{parts}|{int('(' in s)}{int(s[:1] == '+')}"


def aggregate(counts: dict[str, int], rounds: int = EM_ROUNDS) -> dict[str, float]:
    """Probability of personal data for each pattern of votes, by expectation-maximisation per kind.

    Each labeler has, per kind, a rate of 1 votes among true and among false candidates; they are
    taken as independent given the truth. The start is ``TRUST``.
    """
    trust = np.array(TRUST)
    out: dict[str, float] = {}
    for kind in KINDS:
        own = sorted(p for p in counts if p.startswith(f"{kind}|"))
        if not own:
            continue
        n = np.array([counts[p] for p in own], float)
        votes = np.array([[{"1": 1.0, "0": 0.0, "-": np.nan}[v] for v in p.split("|")[1]] for p in own])
        cast, ones = ~np.isnan(votes), np.nan_to_num(votes)
        true = np.where(cast, ones * trust + (1 - ones) * (1 - trust), 1.0).prod(1)
        false = np.where(cast, ones * (1 - trust) + (1 - ones) * trust, 1.0).prod(1)
        q = true / (true + false)
        for _ in range(rounds):
            prior = (n @ q + 1) / (n.sum() + 2)
            a = ((n * q) @ (ones * cast) + 5 * trust) / ((n * q) @ cast + 5)
            b = ((n * (1 - q)) @ (ones * cast) + 5 * (1 - trust)) / ((n * (1 - q)) @ cast + 5)
            log = lambda r: (cast * (ones * np.log(r) + (1 - ones) * np.log(1 - r))).sum(1)  # noqa: E731, B023
            odds = np.log(prior) - np.log(1 - prior) + log(a) - log(b)
            q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        out |= dict(zip(own, q.tolist(), strict=True))
    return out


def features(pattern: str) -> list[str]:
    kind, votes, digits, parts, marks = pattern.split("|")
    return [kind, *[f"{kind}:{name}={v}" for name, v in zip(LABELERS, votes, strict=True)], f"{kind}:digits={digits}", f"{kind}:parts={parts}", f"{kind}:marks={marks}"]


def train(counts: dict[str, int], rounds: int = 400, decay: float = 1e-3) -> dict[str, float]:
    """Weights of the span classifier: logistic regression on the probabilities that :func:`aggregate` gives."""
    truth = aggregate(counts)
    patterns = sorted(truth)
    names = sorted({f for p in patterns for f in features(p)})
    if not patterns:
        return {}
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(patterns), len(names)))
    for i, p in enumerate(patterns):
        x[i, [index[f] for f in features(p)]] = 1
    weight = np.sqrt([counts[p] for p in patterns])  # many equal candidates don't drown the rare forms
    weight /= weight.sum()
    y, w = np.array([truth[p] for p in patterns]), np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + decay * np.eye(len(names))
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - decay * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(names, w.tolist(), strict=True))


def probability(pattern: str, weights: dict[str, float]) -> float:
    return float(1 / (1 + np.exp(-sum(weights.get(f, 0.0) for f in features(pattern)))))


def vote_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """pattern, n: how many candidates of all texts have each pattern of votes and form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: Counter[str] = Counter()
            for s in batch.column(0):
                s = s.as_py()
                if s:
                    got.update(p for *_, p in candidates(s, base_spans(s)))
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], names=["pattern", "n"])

    return docs.select(text).mapInArrow(run, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """The span classifier of a corpus. What comes to the driver is a row for each pattern, a few hundred at most."""
    return train({r.pattern: r.n for r in vote_counts(docs, text).collect()})


def all_spans(text: str, weights: dict[str, float], known: dict[str, float]) -> tuple[list, list]:
    """Base spans, and these with those that the classifier adds."""
    if not text:
        return [], []
    base = base_spans(text)
    every = list(base)
    if weights:
        for start, kind, end, pattern in list(candidates(text, base))[len(base):]:
            p = known.get(pattern)
            if p is None:
                p = known[pattern] = probability(pattern, weights)
            if p >= THRESHOLD:
                every.append((start, kind, end))
    return base, sorted(every)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def find(docs: DataFrame, weights: dict[str, float], text: str = "text") -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans.

    The four counts are of base spans; ``n_spans`` is the number of all. ``spans`` has kind:start:end by start, then kind, comma-joined (code points, end exclusive);
    ``base_sha256`` is the digest of the base ones alone, written likewise. Columns of these names
    are replaced; all others stay.
    """
    new = {"n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string", "n_spans": "bigint"}

    def each(s: str, known: dict) -> tuple:
        base, every = all_spans(s, weights, known)
        n = Counter(k for _, k, _ in base)
        return n[0], n[1], n[2], n[3], hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every)

    return _rows(docs, text, new, each)


def redact(docs: DataFrame, weights: dict[str, float], text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; null stays null."""

    def each(s: str, known: dict) -> tuple:
        _, every = all_spans(s, weights, known)
        out, at = [], 0
        for start, kind, end in every:
            if start >= at:
                out += [s[at:start], f"<{KINDS[kind]}>"]
            at = max(at, end)
        return ("".join([*out, s[at:]]) if every else s,)

    return _rows(docs, text, {text: "string"}, each, replace=True)


def _rows(docs: DataFrame, text: str, new: dict[str, str], each, replace: bool = False) -> DataFrame:
    keep = docs if replace else docs.drop(*new)
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    at = keep.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in slices(batches, at):
            texts = batch.column(at)
            if replace:
                rows = [(None,) if (s := x.as_py()) is None else each(s, known) for x in texts]
            else:
                rows = [each(x.as_py() or "", known) for x in texts]
            made = [pa.array([r[k] for r in rows], kinds[kind]) for k, kind in enumerate(new.values())]
            columns = list(batch.columns)
            if replace:
                columns[at] = made[0]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            else:
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*batch.schema.names, *new])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema] + [f"`{k}` {v}" for k, v in new.items() if not replace]
    return keep.mapInArrow(run, ", ".join(schema))
