"""Secret scanning: fixed patterns, and a linear-chain conditional random field decoded by Viterbi.

The field tags every token (a run of letters, digits and ``+/_=-``) as secret begin,
inside or outside, from its shape, from the two words before it and the word after it,
from the marks beside it, and from the file it stands in. Features and scores of all
tokens of a batch are computed as arrays. Viterbi then runs where it can matter: a token
whose score speaks so strongly for outside that all evidence for secrets in its text
cannot outweigh it is outside on the best path of the whole text (:meth:`Field.open`), so
only the stretches between such tokens are decoded, with the result of decoding all.

Training data: windows of texts of at most ``sample_docs`` rows, chosen by hash, in which
matches of the fixed patterns are the secrets; of windows with a secret, windows around
conspicuous tokens that are none, and other windows, the same number at most is drawn. To
them come generated lines in which secrets of other makes, some without a digit, stand in
usual and unusual places. What the field finds outside the fixed matches is added as kind
``crf``; the fixed matches always stay.

Defined results: a null text is the empty text, without spans; text of any length is read
whole, and offsets are code points; repeated rows are scanned alike; without any row the
field learns from the generated lines alone; other columns are ignored, or kept by
:func:`redact`.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import begin_task, bounded_sample, in_pieces, release, small_batches, texts_of
from tessella.llm.features import Adam

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

Span = tuple[int, int, int]  # start, kind number, end


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by start and then kind."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


# --- features -------------------------------------------------------------------------

_LENGTHS = np.array([3, 4, 6, 8, 12, 16, 20, 24, 32, 40, 48, 64])
#: Feature groups and how many values each has; every token has one value of each.
_GROUPS = {"shape": 16, "case": 4 * 13, "hex": 4, "length": 13, "digits": 7, "switches": 8, "prev": 512, "prev2": 512, "next": 256, "before": 16, "after": 8, "file_marks": 4, "file_open": 4}
_BASES = dict(zip(_GROUPS, np.cumsum([0, *_GROUPS.values()])[:-1].tolist()))
_N_FEATURES = sum(_GROUPS.values())
_LOWER, _UPPER, _DIGITS, _SYMBOLS = 1, 2, 3, 4


def _code_table(kinds: dict[str, int]) -> np.ndarray:
    """The kind of each ASCII character, 0 for those not named; the last entry stands for all others."""
    table = np.zeros(129, np.int64)
    for chars, kind in kinds.items():
        for c in chars:
            table[ord(c)] = kind
    return table


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CLASS = _code_table({_LETTERS: _LOWER, _LETTERS.upper(): _UPPER, "0123456789": _DIGITS, "+/_=-": _SYMBOLS}).astype(np.uint8)
_AFTER = _code_table({" \t\n\r\x0b\x0c": 1, "\"'`": 2, "@": 3, ".": 4, ",;:!?": 5})
_AFTER[(_AFTER == 0)] = 6
#: Three counters of 21 bits in one number, so that one running sum counts all three; longer tokens only get other features.
_BITS = 21
_COUNT_1 = _code_table({_LETTERS: 1, _LETTERS.upper(): 1 << _BITS, "0123456789": 1 << 2 * _BITS})
_COUNT_2 = _code_table({"abcdef": 1, "ABCDEF": 1 << _BITS})
_MARKS = _code_table({":": 1, "\"'`": 1 << _BITS})
_MARKS[[c for c in range(129) if _CLASS[c] == 0 and not chr(c).isspace()]] += 1 << 2 * _BITS
_FOLDED = np.array([ord(chr(c).lower()) for c in range(128)] + [0], np.uint32)
_POWERS = np.cumprod(np.full(24, 2654435761, np.uint64)).astype(np.uint32)


class Tokens:
    """The tokens of a batch of texts: row, start and end in code points, and features."""

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        code = np.minimum(np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4"), 128)
        kind = _CLASS[code]
        on = kind > 0
        edge = np.flatnonzero(np.diff(on, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        row = np.searchsorted(begins, start, "right") - 1
        self.row, self.start, self.end, self.texts = row, start - begins[row], end - begins[row], texts
        n, length = len(start), end - start
        self.features = np.zeros((n, len(_GROUPS)), np.int32)
        if not n:
            return
        low = (1 << _BITS) - 1
        zero = np.zeros(1, np.int64)

        def counts(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sums = np.concatenate([zero, np.cumsum(values)])
            packed = sums[b] - sums[a]
            return packed & low, packed >> _BITS & low, packed >> 2 * _BITS & low

        switched = np.zeros(len(code), np.int64)
        switched[1:] = (kind[1:] != kind[:-1]) & on[1:] & on[:-1]
        lower, upper, digit = counts(_COUNT_1[code], start, end)
        hex_low, hex_up, switches = counts(_COUNT_2[code] + (switched << 2 * _BITS), start, end)
        symbol = length - lower - upper - digit
        long = np.searchsorted(_LENGTHS, length, "right")
        first_up = kind[start] == _UPPER
        case = np.where(upper == 0, 0, np.where((upper == 1) & first_up, 1, np.where(lower == 0, 2, 3)))
        share = np.where(digit == 0, 0, np.where(digit == length, 6, 1 + np.minimum(4, digit * 5 // length)))
        # a hash of each token without regard to case
        inside = np.flatnonzero(on)
        place = np.minimum(inside - np.repeat(start, length), len(_POWERS) - 1)
        word = np.add.reduceat(_FOLDED[code[inside]] * _POWERS[place], np.concatenate([[0], np.cumsum(length)[:-1]])).astype(np.uint32)
        word ^= word >> np.uint32(15)
        word *= np.uint32(0x85EBCA6B)
        before = np.concatenate([[-1], row[:-1]]) == row
        gap_at = np.where(before, np.concatenate([[0], end[:-1]]), begins[row])
        colons, quotes, others = counts(_MARKS[code], gap_at, start)
        prev = np.where(before, np.concatenate([[0], word[:-1] >> np.uint32(23)]), 0)
        before2 = np.concatenate([[-1, -1], row[:-2]])[:n] == row
        prev2 = np.where(before2, np.concatenate([[0, 0], word[:-2] >> np.uint32(23)])[:n], 0)
        after_row = np.concatenate([row[1:], [-1]]) == row
        nxt = np.where(after_row, np.concatenate([word[1:] >> np.uint32(24), [0]]), 0)
        equals = before & (code[np.maximum(gap_at - 1, 0)] == ord("="))
        after = np.where(self.end == sizes[row], 0, _AFTER[code[end]])
        symbols = np.array([sum(map(t.count, "{}()[]<>=;:")) for t in texts])
        loud = np.bincount(row, (digit > 0) | (length >= 20), len(texts)).astype(np.int64)
        values = {
            "shape": (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (symbol > 0),
            "case": 13 * case + long,
            "hex": (hex_low + digit == length) + 2 * (hex_up + digit == length),
            "length": long,
            "digits": share,
            "switches": np.minimum(7, switches * 8 // length),
            "prev": prev,
            "prev2": prev2,
            "next": nxt,
            "before": equals + 2 * (colons > 0) + 4 * (quotes > 0) + 8 * (others == 0),
            "after": after,
            "file_marks": np.minimum(3, symbols * 100 // np.maximum(1, sizes))[row],
            "file_open": np.minimum(3, loud * 2000 // np.maximum(1, sizes))[row],
        }
        for k, (name, base) in enumerate(_BASES.items()):
            self.features[:, k] = values[name] + base


def tags_of(tokens: Tokens, secrets: dict[int, list[tuple[int, int]]]) -> np.ndarray:
    """0 outside, 1 begin, 2 inside, from each row's known secrets."""
    out = np.zeros(len(tokens.row), np.int64)
    for r, spans in secrets.items():
        a, b = np.searchsorted(tokens.row, [r, r + 1])
        for s, e in spans:
            own = a + np.flatnonzero((tokens.start[a:b] < e) & (s < tokens.end[a:b]))
            out[own] = 2
            out[own[:1]] = 1
    return out


# --- the field ------------------------------------------------------------------------


class Field:
    """Weights of a trained field; states are outside, begin, inside."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        # every path of a text makes the same number of moves, so that staying outside can be the zero of the moves
        self.emit, self.move = emit, move - move[0, 0]

    def scores(self, tokens: Tokens) -> np.ndarray:
        """The weight of each token for each state."""
        out = np.zeros((len(tokens.row), 3))
        for k in range(len(_GROUPS)):
            out += self.emit[tokens.features[:, k]]
        return out

    def open(self, scores: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Which tokens can be in a secret on the best path of their text.

        A run of L tokens in a secret makes L + 1 moves, each at most ``top`` better than staying
        outside, so with ``gain``, what each token is better in a secret than outside, the run's
        gains and (L + 1) * top together are 0 or more on a best path. A token that takes more
        away than all tokens of its text together can give is therefore outside.
        """
        top = max(0.0, float(np.delete(self.move.ravel(), 0).max()))
        gain = scores[:, 1:].max(axis=1) - scores[:, 0] + top
        most = np.bincount(row, np.maximum(gain, 0), rows) + top + 1e-6
        return gain >= -most[row]

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """Best tags of one stretch, outside on both sides."""
        move = self.move.tolist()
        score, back = [0.0, 0.0, 0.0], []
        for k, e in enumerate(scores.tolist()):
            if k == 0:
                score = [move[0][y] + e[y] for y in range(3)]
                continue
            best = [max(range(3), key=lambda x: score[x] + move[x][y]) for y in range(3)]
            back.append(best)
            score = [score[best[y]] + move[best[y]][y] + e[y] for y in range(3)]
        y = max(range(3), key=lambda x: score[x] + move[x][0])
        path = [y]
        for best in reversed(back):
            y = best[y]
            path.append(y)
        return path[::-1]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """The (start, end) of each text's secrets."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for rows in in_pieces(texts, 300_000):
            tokens = Tokens([texts[i] for i in rows])
            scores = self.scores(tokens)
            at = np.flatnonzero(self.open(scores, tokens.row, len(rows)))
            runs = np.split(at, np.flatnonzero((np.diff(at) != 1) | (np.diff(tokens.row[at]) != 0)) + 1) if len(at) else []
            for run in runs:
                if (scores[run, 1:].max(axis=1) - scores[run, 0] + 2 * self.move.max() <= 0).all():
                    continue  # no run of its tokens beats outside
                found, last = out[rows[tokens.row[run[0]]]], 0
                for k, tag in zip(run.tolist(), self.viterbi(scores[run])):
                    if tag == 1 or tag == 2 and not last:
                        found.append((int(tokens.start[k]), int(tokens.end[k])))
                    elif tag == 2:
                        found[-1] = (found[-1][0], int(tokens.end[k]))
                    last = tag
        return out


def train(x: np.ndarray, y: np.ndarray, live: np.ndarray, *, steps: int = 120, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """Maximum likelihood by forward-backward and Adam over windows of tokens.

    ``x`` (windows, tokens, groups) holds features, ``y`` tags, ``live`` which places are tokens: those first in a window.
    """
    n, longest, width = x.shape
    emit, move = np.zeros((_N_FEATURES, 3)), np.zeros((3, 3))
    adam, rows = Adam([emit, move], rate), np.arange(n)
    flat = x[live].ravel()
    lengths = live.sum(axis=1)
    last = y[rows, lengths - 1]
    gold = np.eye(3)[y] * live[..., None]

    def lse(a, axis):
        m = a.max(axis=axis, keepdims=True)
        return np.log(np.exp(a - m).sum(axis=axis)) + m.squeeze(axis)

    for _ in range(steps):
        e = sum(emit[x[:, :, g]] for g in range(width)) * live[..., None]
        alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        alpha[:, 0] = move[0] + e[:, 0]
        for k in range(1, longest):
            alpha[:, k] = np.where(live[:, k, None], lse(alpha[:, k - 1, :, None] + move, 1) + e[:, k], alpha[:, k - 1])
        beta[:, longest - 1] = move[:, 0]
        for k in range(longest - 2, -1, -1):
            beta[:, k] = np.where(live[:, k + 1, None], lse(move + (beta[:, k + 1] + e[:, k + 1])[:, None, :], 2), move[:, 0])
        z = lse(alpha[:, -1] + move[:, 0], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
        diff = (gold - node)[live]
        g_emit = np.stack([np.bincount(flat, np.repeat(diff[:, c], width), _N_FEATURES) for c in range(3)], axis=1) / n
        g_move = np.zeros((3, 3))
        g_move[0] += (gold[:, 0] - node[:, 0]).sum(axis=0)
        final = np.exp(alpha[rows, lengths - 1] + move[:, 0] - z[:, None])
        g_move[:, 0] += (np.eye(3)[last] - final).sum(axis=0)
        for k in range(1, longest):
            on = live[:, k]
            if on.any():
                pair = np.exp(alpha[on, k - 1, :, None] + move + (e[on, k] + beta[on, k])[:, None, :] - z[on, None, None])
                g_move += np.einsum("na,nb->ab", gold[on, k - 1], gold[on, k]) - pair.sum(axis=0)
        adam.ascend([g_emit - decay * emit, g_move / n - decay * move])
        np.clip(move, -8, 8, out=move)
    return Field(emit, move)


def generated(count: int = 4000, seed: int = 17) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with known secrets, and lines with numbers, names and lead words that have none."""
    rng = random.Random(seed)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    lower, upper, digit = _LETTERS, _LETTERS.upper(), "0123456789"
    common = "the of and to in is it that was for on are with as be this have from or had by not but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did".split()
    word = lambda: rng.choice(common) if rng.random() < 0.5 else pick(lower, rng.randint(2, 11))
    title = lambda: word().capitalize()
    camel = lambda k: "".join(pick(lower, rng.randint(3, 9)).capitalize() for _ in range(k))
    mixed = lambda n: "".join((str.upper, str.lower)[i % 2 if alternate else rng.randrange(2)](c) for alternate in [rng.random() < 0.3] for i, c in enumerate(pick(lower, n)))
    leads = ["password", "passwd", "passphrase", "pw", "pwd", "pass", "secret", "token", "key", "auth", "credential", "credentials", "login", "bearer", "apikey", "access", "private"]
    joints = [" is ", ": ", " = ", "=", ' = "', ": '", " ", " ", " ", " `", " -> ", '="']
    out = []
    for _ in range(count):
        before = " ".join(title() if rng.random() < 0.15 else word() for _ in range(rng.randint(0, 6)))
        before += rng.choice(["", ".", ",", ":"]) + " " if before else ""
        after = " ".join(word() for _ in range(rng.randint(0, 5)))
        kind = rng.randrange(21)
        if kind < 9:
            value = [
                lambda: pick("0123456789abcdef", rng.choice([24, 32, 40, 64])),
                lambda: "AKIA" + pick(upper + digit, 16),
                lambda: pick(lower + upper + digit, rng.randint(12, 48)),
                lambda: pick(lower + upper + digit + "+/", 40) + "==",
                lambda: rng.choice(["ghp_", "sk-", "xoxb-", "glpat-"]) + pick(lower + upper + digit, rng.randint(20, 40)),
                lambda: pick(upper + digit, rng.randint(20, 40)),
                lambda: rng.choice([camel(rng.randint(2, 4)), "".join(rng.choice((str.lower, str.upper, str.capitalize))(pick(lower, rng.randint(3, 8))) for _ in range(3))]),
                lambda: mixed(rng.randint(8, 24)),
                lambda: pick(lower, rng.randint(4, 9)) + pick(digit, rng.randint(1, 4)) + rng.choice(["", pick(lower + upper, 3)]),
            ][kind]()
            led = kind >= 6 or rng.random() < 0.8
            lead = rng.choice([str, str.capitalize, str.upper])(rng.choice(leads)) + rng.choice(joints) if led else ""
            tail = lead[-1] if lead[-1:] in ("\"", "'", "`") else ""
            text = f"{before}{lead}"
            out.append((f"{text}{value}{tail}{rng.choice([' ', '. ', ', '])}{after}", [(len(text), len(text) + len(value))]))
            continue
        value = [
            lambda: str(rng.randint(0, 10**6)),
            lambda: f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
            lambda: pick(digit, 16),
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
            lambda: f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com",
            lambda: rng.choice([f"{word()}{rng.randint(1, 99)}", f"https://{word()}.org/{word()}/{word()}-{rng.randint(1, 999)}"]),
            lambda: rng.choice([camel(2), pick(upper, rng.randint(2, 12)), pick(lower, rng.randint(12, 24)), f"{word()}-{word()}", f"{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}"]),
            lambda: rng.choice([str, str.capitalize, str.upper])(rng.choice(leads)) + rng.choice([" is ", " was ", " ", ": ", ", ", " = "]) + rng.choice(["the", "a", "not", "too", "required", "wrong", "expired", "never", "needed", word(), word()]) + " " + word(),
            lambda: " ".join(rng.choice([word(), title()]) for _ in range(8)),
            lambda: " ".join(word().upper() for _ in range(5)) + "!",
            lambda: " ".join(rng.choice([camel(2), title(), word()]) for _ in range(4)),
            lambda: f"{rng.choice(leads)} {rng.choice(['of', 'for', 'in', 'and'])} {title()} {word()}",
        ][kind - 9]()
        out.append((f"{before}{value} {after}", []))
    return out


#: Tokens in a training window.
WINDOW = 12


def windows(texts: list[str], secrets: dict[int, list[tuple[int, int]]], pick: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, features, tags): windows about each secret (2), about a conspicuous token (1) and elsewhere (0).

    ``pick`` holds a number for each text, which chooses among its windows of the last two kinds.
    """
    tokens = Tokens(texts)
    tags = tags_of(tokens, secrets)
    bases = np.searchsorted(tokens.row, np.arange(len(texts) + 1))
    length = tokens.end - tokens.start
    loud = (tokens.features[:, 4] > _BASES["digits"]) | (length >= 20) | (tokens.features[:, 5] > _BASES["switches"] + 1)
    out = []
    for r in range(len(texts)):
        a, b = int(bases[r]), int(bases[r + 1])
        if a == b:
            continue
        marked = tags[a:b] > 0
        middles = [(2, a + int(i)) for i in np.flatnonzero(tags[a:b] == 1)]
        for kind, able in ((1, loud[a:b] & ~marked), (0, ~marked)):
            places = np.flatnonzero(able)
            if len(places):
                middles.append((kind, a + int(places[pick[r] % len(places)])))
        for kind, m in middles:
            i = min(max(a, m - WINDOW // 2), max(a, b - WINDOW))
            j = min(b, i + WINDOW)
            if kind == 2 or not tags[i:j].any():
                out.append((kind, tokens.features[i:j], tags[i:j]))
    return out


def stacked(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as the arrays that :func:`train` takes."""
    n = len(found)
    x, y, live = np.zeros((n, WINDOW, len(_GROUPS)), np.int32), np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), bool)
    for i, (f, t) in enumerate(found):
        x[i, : len(f)], y[i, : len(f)], live[i, : len(f)] = f, t, True
    return x, y, live


def _generated_windows() -> list[tuple[np.ndarray, np.ndarray]]:
    """Every token of the generated lines, in windows one after the other."""
    lines = generated()
    tokens = Tokens([t for t, _ in lines])
    tags = tags_of(tokens, {i: s for i, (_, s) in enumerate(lines)})
    bases = np.searchsorted(tokens.row, np.arange(len(lines) + 1)).tolist()
    return [(tokens.features[i : min(i + WINDOW, b)], tags[i : min(i + WINDOW, b)]) for a, b in zip(bases, bases[1:]) for i in range(a, b, WINDOW)]


def _weak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_texts, picks = texts_of(batch.column(0)), batch.column(1).to_pylist()
        for rows in in_pieces(all_texts, 300_000):
            texts, secrets = [all_texts[i] for i in rows], {}
            for i, text in enumerate(texts):
                # of an assignment, the value alone is the secret
                values = [(m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if any(k in text.lower() for k in _KEYWORDS) else []
                if own := sorted({*values, *((s, e) for s, k, e in base_spans(text) if k)}):
                    secrets[i] = own
            found = windows(texts, secrets, [picks[i] for i in rows])
            cols = [pa.array([k for k, _, _ in found], pa.int32()), pa.array([f.astype("<i4").tobytes() for _, f, _ in found], pa.binary()), pa.array([t.astype(np.uint8).tobytes() for _, _, t in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["kind", "features", "tags"])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 10_000, sample_windows: int = 4000) -> Field:
    """Train on windows of a bounded sample of rows, ``sample_windows`` of each kind at most, and on generated lines."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(F.lit(3), F.col(id_col), text), F.lit(1 << 30)).alias("pick"))
    got = bounded_sample(rows, ["doc_id", "text"], sample_docs).select("text", "pick").mapInArrow(_weak, "kind int, features binary, tags binary").toArrow()
    by_kind: dict[int, list[tuple[bytes, bytes]]] = {0: [], 1: [], 2: []}
    for kind, f, t in zip(got.column("kind").to_pylist(), got.column("features").to_pylist(), got.column("tags").to_pylist()):
        by_kind[kind].append((f, t))
    chosen = [w for found in by_kind.values() for w in sorted(set(found), key=lambda w: (zlib.crc32(w[0]), w))[:sample_windows]]
    known = [(np.frombuffer(f, "<i4").reshape(-1, len(_GROUPS)), np.frombuffer(t, np.uint8).astype(np.int64)) for f, t in chosen]
    field = train(*stacked(known + _generated_windows()))
    release()
    return field


def all_spans(field: Field, texts: list[str]) -> list[list[Span]]:
    """Each text's fixed matches, and what the field adds where no fixed match is."""
    out = []
    for text, found in zip(texts, field.spans(texts)):
        base = base_spans(text)
        out.append(sorted(base + [(a, 3, b) for a, b in found if not any(a < e and s < b for s, _, e in base)]))
    return out


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of each row: counts of the fixed kinds, digest of the fixed spans, all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("secret_scan")
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for spans in all_spans(field, texts_of(batch.column(1))):
                base = [s for s in spans if s[1] < 3]
                for k in range(3):
                    cols[k].append(sum(s[1] == k for s in spans))
                cols[3].append(hashlib.sha256(_written(base).encode()).hexdigest())
                cols[4].append(_written(spans))
                cols[5].append(len(spans) - len(base))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, field: Field, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; all rows and columns stay, null stays null."""

    def cover(text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for a, _, b in spans:
            if b <= at:
                continue
            if a >= at:
                out += [text[at:a], mark]
            at = b
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("secret_scan")
        for batch in batches:
            names = batch.schema.names
            i = names.index(text_col)
            texts = batch.column(i).to_pylist()
            spans = all_spans(field, [t or "" for t in texts])
            new = pa.array([None if t is None else cover(t, own) for t, own in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == i else batch.column(k) for k in range(len(names))], names=names)

    own = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return own.mapInArrow(run, own.schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document."""
    from tessella.session import table

    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
