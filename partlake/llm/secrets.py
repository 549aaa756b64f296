"""Secret scanning: fixed patterns, and a linear-chain conditional random field beside them.

The patterns give the base spans. The field tags tokens as begin (B), inside (I) or
outside (O) of a secret from their shape, the words around them and features of the
whole file, and is decoded by Viterbi. It learns from sampled texts, where the base
patterns tag the tokens, and from the same texts with made-up secrets and made-up
harmless tokens put between their words. Words (see ``_RUN``) can only be outside, so a
chain falls apart at them into short runs that are decoded by themselves: the result is
that of one pass over the whole text. What the field finds beyond the base spans is
added; base spans are never taken away.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlake.llm.batches import slices_by_bytes, text_batches
from partlake.llm.sampling import bounded_sample

KINDS = ("assign", "access", "hex", "field")

#: The base patterns; letters of the first match in either case, as ASCII has them.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("pass", "secret", "token", "key")

#: Characters of a run: visible ASCII but for quotes, brackets and list marks.
_SIGN = r"A-Za-z0-9+/_=!$%^*#~&?:.@\-"
#: A run may hold a secret: 8 or more characters with a letter and a digit, or a capital after a small letter, or 20 or more. All else is a word.
_RUN = re.compile(rf"(?<![\w{_SIGN[9:]}])(?:(?=[{_SIGN}]*[0-9])(?=[{_SIGN}]*[A-Za-z])|(?=[{_SIGN}]*[a-z][A-Z])|(?=[{_SIGN}]{{20}}))[{_SIGN}]{{8,}}+(?!\w)")
#: The tokens of a run; an equals sign ends one.
_PART = re.compile(r"[A-Za-z0-9+/_!$%^*#~&?@\-]+={0,2}")
_LINK = re.compile(r"://|^www\.|\.(?:com|org|net|html?|php)\b", re.I | re.A)
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.", re.A)
_LOWS = re.compile(r"[a-z]+")
_WORDLIKE = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}")
_KEYWORD = re.compile(r"(pass(word|wd|phrase)?|secret|token|api_?key|access_?key|private|credential|bearer|auth)", re.I | re.A)
TAGS = ("O", "B", "I")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping within a kind, in code points."""
    out = []
    low = text.lower() if text.isascii() else text.casefold()
    if any(h in low for h in _HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def token_features(text: str, start: int, end: int, run: tuple[int, int], file: list[str], place: int) -> list[str]:
    """Shape, neighbouring words and file features of the token ``text[start:end]``, number ``place`` of its run."""
    w = text[start:end]
    before = text[max(0, run[0] - 40) : start][-60:]
    after = text[end : end + 16]
    n = len(w)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in w]
    changes = sum(x != y for x, y in zip(kinds, kinds[1:]))
    shape = "".join(k for k in "duls" if k in kinds)
    size = min(n, 64) // 8
    low = max((len(x) for x in _LOWS.findall(w)), default=0)
    wordy = 4 * sum(len(x) for x in _WORDLIKE.findall(w)) // n
    letters = [c for c in w.lower() if "a" <= c <= "z"]
    vowels = 5 * sum(c in "aeiou" for c in letters) // max(1, len(letters))
    spread = int(8 * _entropy(w) / math.log2(max(2, min(n, 64))))
    whole = min(run[1] - run[0], 80) // 8
    f = [
        "bias",
        "shape=" + shape,
        f"length={size}",
        f"shape={shape}:length={size // 2}",
        f"entropy={int(2 * _entropy(w))}",
        f"spread={spread}:length={size // 2}",
        f"changes={min(9, 10 * changes // n)}",
        f"changes={min(9, 10 * changes // n)}:length={size // 2}",
        f"small run={min(low, 9)}",
        f"words={wordy}",
        f"words={wordy}:changes={min(9, 10 * changes // n)}",
        f"vowels={vowels}:small run={min(low, 6) // 2}",
        f"run length={whole}",
        "start=" + w[:4],
        "hexadecimal" if not w.strip("0123456789abcdef") else "HEXADECIMAL" if not w.strip("0123456789ABCDEF") else "mixed",
        "last=" + (before.rstrip()[-1:] or "^"),
        "next=" + (after.strip()[:1] or "$"),
    ]
    if any(c in "!$%^*#~&?@" for c in w.rstrip("!$%^*#~&?")):
        f += ["sign inside", f"sign inside:shape={shape}"]
    if len(set(w)) * 4 <= n:
        f.append("few letters")
    words = re.findall(r"[A-Za-z_]+", before)[-2:]
    f += [f"word-{len(words) - i}=" + x.lower()[:12] for i, x in enumerate(words)]
    if _KEYWORD.search(before):
        f.append("keyword before")
    if re.search(r"[:=]\s*[\"']?$", before):
        f.append("assigned")
        if _KEYWORD.search(before):
            f.append("keyword assigned")
    around = text[run[0] : min(run[1], run[0] + 200)]
    if _LINK.search(around):
        f += ["in a link", f"in a link:changes={min(9, 10 * changes // n)}"]
    if _MAIL.search(around):
        f.append("in an address")
    if place:
        f += ["joined to the token before", "joined by=" + text[start - 1 : start]]
    return f + file


def file_features(text: str) -> list[str]:
    n = max(1, len(text))
    head = []
    if text.count("=") * 200 > n:
        head.append("file: many assignments")
    if text.count("\n") * 40 > n:
        head.append("file: short lines")
    if text.count("{") + text.count(";") > n / 200:
        head.append("file: code")
    return head


def candidate_runs(text: str) -> Iterator[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """(place of a run, places of its tokens); all other tokens are words, and outside."""
    for m in _RUN.finditer(text):
        a, b = m.span()
        tokens = [x.span() for x in _PART.finditer(text, a, b)]
        if tokens:
            yield (a, b), tokens


class Field:
    """Weights of a linear-chain conditional random field over O, B and I."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, feats: Iterable[list[str]]) -> np.ndarray:
        """Three numbers a token; the features of one token are held at a time."""
        out = array("d")
        for f in feats:
            out.extend(self.emit[[self.names[x] for x in f if x in self.names]].sum(axis=0))
        return np.frombuffer(out, dtype=np.float64).reshape(-1, 3)

    def decode(self, feats: Iterable[list[str]]) -> list[int]:
        """The best tag sequence (Viterbi); row 3 of ``move`` is the start."""
        e = self.scores(feats)
        back = np.zeros((len(e), 3), dtype=np.int8)
        best = e[0] + self.move[3]
        for i in range(1, len(e)):
            grid = best[:, None] + self.move[:3]
            back[i] = grid.argmax(axis=0)
            best = grid.max(axis=0) + e[i]
        tags = [int(best.argmax())]
        for i in range(len(e) - 1, 0, -1):
            tags.append(int(back[i][tags[-1]]))
        return tags[::-1]


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _LOWER + _UPPER + _DIGITS


def _maker(rng: np.random.Generator):
    def of(chars: str, low: int, high: int | None = None) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), low if high is None else rng.integers(low, high + 1)))

    return of


def made_up_secrets(rng: np.random.Generator) -> dict[str, Callable[[], str]]:
    """Makers of random secrets, by kind."""
    of = _maker(rng)
    url = _ALNUM + "_-"

    def password() -> str:
        parts = [of(_LOWER, 2, 5), of(_UPPER, 2, 4), of(_DIGITS, 2, 4), of("!$%^*#~&?@+-_", 1, 3)]
        w = "".join(parts)
        return "".join(w[i] for i in rng.permutation(len(w))) if rng.integers(3) else of(_ALNUM, 4) + of(_DIGITS, 1) + of(_ALNUM, 5, 11)

    return {
        "web token": lambda: f"eyJ{of(url, 17, 60)}.eyJ{of(url, 20, 120)}.{of(url, 43)}",
        "slack": lambda: f"xox{of('bpars', 1)}-{of(_DIGITS, 10, 13)}-{of(_DIGITS, 10, 13)}-{of(_ALNUM, 24, 32)}",
        "github": lambda: f"gh{of('pousr', 1)}_{of(_ALNUM, 36)}",
        "google": lambda: f"AIza{of(url, 35)}",
        "stripe": lambda: f"{of('srp', 1)}k_{('live', 'test')[rng.integers(2)]}_{of(_ALNUM, 24, 34)}",
        "prefixed": lambda: f"{of(_LOWER, 2, 5)}{of('_-', 1)}{of(_ALNUM, 20, 40)}",
        "base62": lambda: of(_ALNUM, 20, 48),
        "base64": lambda: of(_ALNUM + "+/", 30, 64) + ("", "=", "==")[rng.integers(3)],
        "url safe": lambda: of(url, 22, 48).strip("-_"),
        "upper hex": lambda: of("0123456789ABCDEF", 24, 48),
        "upper code": lambda: of(_UPPER + _DIGITS, 20, 36),
        "bot": lambda: f"{of(_DIGITS, 9, 10)}:AA{of(url, 33)}",
        "password": password,
    }


def made_up_harmless(rng: np.random.Generator) -> list[Callable[[], str]]:
    """Makers of links, dates, versions, addresses, names and numbers: long tokens that are no secrets."""
    of = _maker(rng)
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(of("bcdfghklmnprstvwz", 1) + of("aeiou", 1) + pick("", "", of("lnrst", 1)) for _ in range(rng.integers(1, 5)))
    n = lambda k: of(_DIGITS, 1, k)
    hexa = lambda k: of("0123456789abcdef", k)
    return [
        lambda: f"https://{word()}.example.com/{word()}/{word()}-{n(4)}/{n(6)}?id={n(9)}&page={n(2)}",
        lambda: f"http{pick('', 's')}://www.{word()}{word()}.{pick('org', 'net', 'com')}/{word()}_{word()}/{word().title()}{word().title()}.{pick('html', 'pdf', 'php')}#{word()}",
        lambda: f"20{of(_DIGITS, 2)}-{of(_DIGITS, 2)}-{of(_DIGITS, 2)}T{of(_DIGITS, 2)}:{of(_DIGITS, 2)}:{of(_DIGITS, 2)}Z",
        lambda: f"/{word()}/{word()}_{n(3)}/{word()}.{pick('html', 'py', 'txt', 'parquet')}",
        lambda: "/".join(word() for _ in range(rng.integers(2, 6))) + "/" + "".join(word().title() for _ in range(rng.integers(1, 4))) + pick("", n(2), "." + word(), n(1) + "." + of(_LOWER, 2, 4)),
        lambda: f"{word()}{pick('-', '_', '')}{n(1)}.{n(1)}.{n(2)}{pick('', '-rc1', '-beta2', '.tar.gz', '.zip')}",
        lambda: f"{word()}{pick('.', '_', '')}{word()}{n(2)}@{word()}{n(1)}.example.com",
        lambda: f"+{n(2)}-{of(_DIGITS, 3)}-{of(_DIGITS, 3)}-{of(_DIGITS, 4)}",
        lambda: of(_DIGITS, 12, 24),
        lambda: "-".join(word() for _ in range(rng.integers(3, 7))),
        lambda: "_".join(word() for _ in range(rng.integers(2, 6))) + pick("", "_" + n(4), n(2)),
        lambda: word() + "".join(word().title() for _ in range(rng.integers(1, 5))) + pick("", "", n(2), "()"),
        lambda: word().upper() + "_" + word().upper() + pick("", "_" + n(3), "=" + n(4)),
        lambda: "".join(word() for _ in range(rng.integers(4, 9))),
        lambda: f"{of(_UPPER, 1, 4)}{pick('-', '/', '')}{of(_DIGITS, 3, 6)}{pick('-', '/', '')}{of(_UPPER + _DIGITS, 1, 6)}",
        lambda: f"{hexa(8)}-{hexa(4)}-4{hexa(3)}-a{hexa(3)}-{hexa(12)}",
        lambda: hexa(int(rng.integers(7, 13))),
        lambda: "".join(pick("C", "H", "O", "N", "Na") + n(2) for _ in range(rng.integers(4, 8))),
        lambda: pick("=", "-", "_", "*", "#", "ab", "x1", "a1B", "=-") * int(rng.integers(12, 60)),
        lambda: f"{word()}{of('$%#*!&', 1) * 3}{word()}{n(3)}{of('$%#*!&', 1) * 3}",
        lambda: f"{word().title()}{n(4)}{pick('', '!', '?', ':')}{word().title()}",
        lambda: f"{of(_DIGITS, 1, 3)}.{of(_DIGITS, 1, 3)}.{of(_DIGITS, 1, 3)}.{of(_DIGITS, 1, 3)}:{n(4)}/{word()}",
        lambda: f"{word()}{of(_DIGITS, 1, 4)}{word()}",
    ]


#: Where a made-up token stands.
_AROUND = ("%s", "%s", "%s", "%s.", "%s,", "(%s)", '"%s"', "'%s'", "`%s`", "= %s", ": %s", "id: %s", 'value = "%s"', "credential: %s", "Bearer %s", "use %s now")


def _lessons(rng: np.random.Generator, texts: list[str], made: int) -> Iterator[tuple[str, list[tuple[str, int, int]], list[str], bool]]:
    """(text, secret spans, file features, planted): the sampled texts, then stretches of them with a made-up token each, secret or harmless by turns."""
    for t in texts:
        yield t, base_spans(t), file_features(t), False
    kinds_of, harmless = made_up_secrets(rng), made_up_harmless(rng)
    secret = [*kinds_of.values(), kinds_of["password"]]  # the kind that is most like a name
    stand = [t for t in texts if t.strip()] or ["some words of a text that stand around"]
    for i in range(made):
        kinds = harmless if i % 2 else secret
        token = kinds[i // 2 % len(kinds)]()
        t = stand[rng.integers(len(stand))]
        at = t.find(" ", int(rng.integers(len(t))))
        left, right = (t[max(0, at - 60) : at + 1], t[at : at + 40]) if at >= 0 and rng.integers(8) else ("", "")
        form = _AROUND[rng.integers(len(_AROUND))]
        start = len(left) + form.index("%s")
        text = left + form % token + right
        spans = [x for x in base_spans(text) if x[2] <= len(left) or x[1] >= start + len(token)]
        if not i % 2:
            spans.append(("field", start, start + len(token)))
        yield text, spans, file_features(t), True


def fit_field(texts: list[str], rounds: int = 8, rate: float = 0.3, ridge: float = 1e-3, seed: int = 5, made: int = 8000) -> Field:
    """Maximum likelihood by stochastic gradients, with forward-backward sums for the expected counts.

    In sampled texts the base patterns label the tokens: those inside a base span are B or I,
    all others O. ``made`` lessons more hold a made-up token, secret or harmless, between words
    of the samples. Copies of secret runs without their surroundings teach the field to go by
    shape where nothing announces a secret.
    """
    rng = np.random.default_rng(seed)
    data: list[tuple[list[list[str]], list[int]]] = []
    for t, spans, file, planted in _lessons(rng, texts, made):
        for run, tokens in candidate_runs(t):
            tags, feats, open_ = [], [], None
            for k, (a, b) in enumerate(tokens):
                hit = next((s for s in spans if s[1] < b and a < s[2]), None)
                tags.append(0 if hit is None else 2 if open_ == hit else 1)
                open_ = hit
                feats.append(token_features(t, a, b, run, file, k))
            data.append((feats, tags))
            if planted or any(tags):
                bare = [[x for x in f if not x.startswith(("word-", "keyword", "assigned", "last=", "next=", "start="))] for f in feats]
                data.append((bare, tags))
    names: dict[str, int] = {}
    for feats, _ in data:
        for f in feats:
            for x in f:
                names.setdefault(x, len(names))
    emit, move = np.zeros((len(names), 3)), np.zeros((4, 3))
    move[3, 2] = move[0, 2] = -8.0  # a secret does not start inside
    coded = [([np.array([names[x] for x in f]) for f in feats], tags) for feats, tags in data]
    for r in range(rounds):
        step = rate / (1 + r / 3)
        for k in rng.permutation(len(coded)):
            feats, tags = coded[k]
            n = len(feats)
            if n == 1:  # most runs are one token, whose sums are one line
                e = emit[feats[0]].sum(axis=0) + move[3]
                g = -np.exp(e - e.max())
                g /= -g.sum()
                g[tags[0]] += 1
                emit[feats[0]] += step * g
                move[3] += step * g
                continue
            e = np.array([emit[f].sum(axis=0) for f in feats])
            fwd, bwd = np.zeros((n, 3)), np.zeros((n, 3))
            fwd[0] = e[0] + move[3]
            for i in range(1, n):
                fwd[i] = np.logaddexp.reduce(fwd[i - 1][:, None] + move[:3], axis=0) + e[i]
            for i in range(n - 2, -1, -1):
                bwd[i] = np.logaddexp.reduce(move[:3] + e[i + 1] + bwd[i + 1], axis=1)
            z = np.logaddexp.reduce(fwd[-1])
            p = np.exp(fwd + bwd - z)
            for i, f in enumerate(feats):
                g = -p[i]
                g[tags[i]] += 1
                emit[f] += step * g
            for i in range(1, n):
                pair = np.exp(fwd[i - 1][:, None] + move[:3] + e[i] + bwd[i] - z)
                move[:3] -= step * pair
                move[tags[i - 1], tags[i]] += step
            move[3] -= step * p[0]
            move[3, tags[0]] += step
        emit *= 1 - ridge
    return Field(names, emit, move)


def field_spans(text: str, field: Field) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    file: list[str] | None = None
    for run, tokens in candidate_runs(text):
        if file is None:
            file = file_features(text)
        prev = 0
        for (a, b), tag in zip(tokens, field.decode(token_features(text, a, b, run, file, k) for k, (a, b) in enumerate(tokens))):
            if tag == 1 or (tag == 2 and prev == 0):
                out.append(("field", a, b))
            elif tag == 2:
                out[-1] = ("field", out[-1][1], b)
            prev = tag
    return out


def outside(text: str, spans: list[tuple[str, int, int]], base: list[tuple[str, int, int]], least: int = 8) -> list[tuple[str, int, int]]:
    """The parts of ordered spans that no base span covers, without signs at their ends; parts under ``least`` characters go.

    A span that meets no base span stays as it is. One pass over both lists.
    """
    covered = sorted((b[1], b[2]) for b in base)
    out, k = [], 0
    for kind, a, b in spans:
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        j, at, parts = k, a, []
        while j < len(covered) and covered[j][0] < b:
            parts.append((at, covered[j][0]))
            at = max(at, covered[j][1])
            j += 1
        if j == k:
            out.append((kind, a, b))
            continue
        for x, y in [*parts, (at, b)]:
            while x < y and not text[x].isalnum():
                x += 1
            while x < y and not text[y - 1].isalnum():
                y -= 1
            if y - x >= least:
                out.append((kind, x, y))
    return out


def find_secrets(text: str | None, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans). Of a span of the field what lies outside the base spans is added."""
    if not text:
        return [], []
    base = base_spans(text)
    more = outside(text, field_spans(text, field), base)
    return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 600) -> Field:
    """Fit the field on at most ``sample_rows`` rows with a base match and as many without, 20,000 characters of each."""
    text = F.col(text_col)
    has = text.rlike(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}") | (
        text.rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")
    )
    texts = []
    for wanted in (has, ~has):
        texts += bounded_sample(docs.where(wanted), sample_rows, text_col, id_col)
    return fit_field(texts)


def scan_secrets(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``base``, ``spans``): arrays of (kind, start, end) of every row's whole text, in code points, end exclusive.

    Null and empty texts have none. Rows are independent: repeated ids and texts stay;
    other columns are not read. Spans are in order of start, then kind.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices_by_bytes(b, 1):
                found = [find_secrets(t, field) for t in s.column(1).to_pylist()]
                cols = [pa.array([[dict(zip(("kind", "start", "end"), x)) for x in f[i]] for f in found], span) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([s.column(0), *cols], names=[id_col, "base", "spans"])

    struct = "array<struct<kind: string, start: long, end: long>>"
    return text_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, base {struct}, spans {struct}")


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span replaced; overlapping spans give one mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]
