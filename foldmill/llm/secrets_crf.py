"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmill.llm.common import batches, drop_table, map_texts, materialise

#: Kinds of spans, in their order; "crf" is what the field adds.
KINDS = ("assign", "access", "hex", "crf")
#: The patterns of the contract, as they stand; letters of an assignment in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that secrets are also given under; the patterns don't know them.
HINTS = ("pwd", "pass", "passphrase", "credential", "credentials", "auth", "bearer", "authorization", "key", "pin", "signature", "sig", "psk", "cookie")

#: Documents the field is fitted on, at most: those whose ids hash smallest.
FIT_DOCS = 8_000
#: Tokens of a training window; windows without a secret drawn from each document.
WINDOW, CLEAN_WINDOWS = 24, 1
#: Times a secret's window is seen again with another value, and a clean one with a drawn token.
REDRAWN, REDRAWN_CLEAN = 6, 2
#: Times a secret's window is seen with another naming word and a value that may be short.
HINTED = 3
#: Values and tokens that are drawn for that.
DRAWN = 4_000
#: Windows with a secret, and as many without, that the fit sees at most: those that hash smallest.
FIT_WINDOWS = 6_000
#: Windows that a task gathers before it hands them on.
KEPT_WINDOWS = 4096
#: Hashed features, steps of the fit, windows of a step, ridge.
WIDTH, STEPS, STEP_ROWS, RIDGE = 1 << 13, 200, 256, 1e-6
#: A training window with a secret counts as so many without.
SECRET_WEIGHT = 8.0
#: Shortest span that the field adds, in characters: what is shorter is left to the patterns.
LEAST_ADDED = 8
#: States.
OUT, BEGIN, IN = 0, 1, 2

#: Tokens: what stands between white space, quotes, brackets and assignment signs.
TOKEN = re.compile(r"""[^\s:="'`,;()<>{}\[\]]+""")
KEPT_TOKENS = 300_000


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost, not overlapping within a kind, long enough."""
    out = []
    low = text.lower()
    if any(n in low for n in ("password", "passwd", "secret", "token", "api")):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if any(len(t) >= LEAST["hex"] for t in text.split()):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def secret_parts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Where the secrets themselves stand: of an assignment only its value."""
    out = []
    for kind, a, b in spans:
        out.append(ASSIGN.match(text, a).span(2) if kind == "assign" else (a, b))
    return out


def named(token: str) -> bool:
    """Whether a token says that a secret may follow."""
    bare = token.lower().strip("_-.")
    return bare.endswith(NAMES) or bare in HINTS or bare.rpartition("_")[2] in HINTS


def signature(token: str) -> str:
    """Plain words that have the same features share a signature; any other token is its own.

    A plain word is letters alone, short, maybe with a full stop, and not one
    of the names that secrets are given under.  Its signature is a word of the
    same length, case and ending.
    """
    bare = token.rstrip(".!?")
    n = len(bare)
    if not bare.isalpha() or n >= 16 or named(bare):
        return token
    case = "A" * n if bare.isupper() else "A" + "x" * (n - 1) if bare[0].isupper() else "x" * n
    return case + ("." if len(token) > n else "")


def shape(token: str) -> list[str]:
    """Features of a token (a signature) by itself."""
    n = len(token)
    low = sum(c.islower() for c in token)
    up = sum(c.isupper() for c in token)
    digits = sum(c.isdigit() for c in token)
    counts = Counter(token)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    runs = re.sub(r"(.)\1+", r"\1", "".join("d" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token))
    turns = sum((a.isdigit() != b.isdigit()) for a, b in zip(token, token[1:]))
    bare = token.lower().strip("_-.")
    letters = [c in "aeiouyàáäèéêíóöúüAEIOUY" for c in token if c.isalpha()]
    closed = max((len(run) for run in re.split("[aeiouyàáäèéêíóöúü]|[^a-zçñß]", token.lower())), default=0)  # consonants in a row
    signs = sum(not c.isalnum() for c in token.strip(".,!?*$#%&-_"))
    return [
        f"len{min(n, 64).bit_length()}", f"len{min(n // 4, 12)}q", f"low{4 * low // n}", f"up{4 * up // n}", f"dig{4 * digits // n}",
        f"ent{int(2 * entropy)}", f"runs{runs[:8]}", f"turns{min(turns, 8)}", f"hex{int(bool(re.fullmatch('[0-9a-f]+', token)))}{min(n // 8, 5)}",
        f"caps{int(token.isupper())}{min(n // 8, 5)}", f"key{int(bare in NAMES)}", f"endkey{int(bare.endswith(NAMES))}", f"at{int('@' in token)}", f"dots{min(token.count('.'), 4)}",
        f"hint{int(bare in HINTS or bare.rpartition('_')[2] in HINTS)}", f"closed{min(closed, 9)}", f"open{4 * sum(letters) // max(len(letters), 1)}", f"signs{min(signs, 5)}{min(n // 8, 3)}", f"parts{min(len(re.findall('[A-Z][a-z]{2,}|[a-z]{3,}', token)), 6)}{min(n // 8, 3)}",
    ]


def coarse(token: str) -> list[str]:
    """What a neighbour sees of a token (a signature)."""
    bare = token.lower().strip("_-.")
    kind = "k" if bare.endswith(NAMES) else "h" if named(bare) else "d" if any(c.isdigit() for c in token) else "w" if bare.isalpha() else "o"
    return [f"kind{kind}", f"long{min(len(token) // 8, 3)}", f"word{bare}" if bare in NAMES or bare in HINTS else "word-"]


def slots(prefix: str, features: list[str]) -> list[int]:
    return [zlib.crc32(f"{prefix}:{f}".encode("utf-8", "surrogatepass")) % WIDTH for f in features]


def file_features(text: str, tokens: int) -> list[str]:
    """Features of the whole text, the same at each of its tokens."""
    signs = text.count("=") + text.count("{") + text.count(";")
    return [f"tokens{min(tokens, 1 << 14).bit_length()}", f"signs{min(8 * signs // max(tokens, 1), 4)}", f"lines{min(text.count(chr(10)), 255).bit_length()}"]


OWN, NEXT_TO = len(shape("x")), len(coarse("x"))
PER_TOKEN = OWN + 2 * NEXT_TO + len(file_features("", 0))
EDGE = {"before": slots("before", ["edge"] * NEXT_TO), "after": slots("after", ["edge"] * NEXT_TO)}


@lru_cache(maxsize=100_000)
def token_slots(sign: str) -> tuple[list[int], list[int], list[int]]:
    """Feature slots of a signature: of the token, of it as the word before, of it as the word after."""
    near = coarse(sign)
    return slots("own", shape(sign)), slots("before", near), slots("after", near)


@dataclass(frozen=True)
class Field:
    """Weights of features by state, of steps between states, and of the first state."""

    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray


def window_slots(signs: dict[int, str], part: range, n: int, whole: list[int]) -> list[int]:
    """Feature slots of the tokens of a window, one after the other; ``n`` is the text's number of tokens."""
    three = {i: token_slots(sign) for i, sign in signs.items()}
    before = lambda i: three[i - 1][1] if i else EDGE["before"]
    after = lambda i: three[i + 1][2] if i + 1 < n else EDGE["after"]
    return [v for i in part for v in (*three[i][0], *before(i), *after(i), *whole)]


def drawn_secret(r: random.Random) -> str:
    """A value that a secret might have: random signs of one alphabet, now and then behind a prefix."""
    upper, letters, digits = string.ascii_uppercase, string.ascii_letters, string.digits
    alphabet = r.choice(["0123456789abcdef", "0123456789ABCDEF", letters + digits, letters + digits, letters + digits + "_-", letters + digits + "+/", upper + digits, string.ascii_lowercase + digits])
    value = "".join(r.choice(alphabet) for _ in range(r.randrange(14, 65)))
    prefix = r.choice(["", "", "", "".join(r.choice(upper) for _ in range(4)), "".join(r.choice(string.ascii_lowercase) for _ in range(r.randrange(2, 5))) + r.choice("_-")])
    return prefix + value


def drawn_short(r: random.Random) -> str:
    """What may stand behind a naming word: a password with or without signs, or letters alone, sometimes short."""
    both, signs = string.ascii_letters + string.digits, "!@#$%^&*+-_.~?/"
    kind = r.randrange(4)
    if kind == 0:
        return "".join(r.choice(both) for _ in range(r.randrange(8, 18)))
    if kind == 1:
        return "".join(r.choice(both + signs) for _ in range(r.randrange(9, 20)))
    if kind == 2:
        return "".join(r.choice(r.choice([string.ascii_lowercase, string.ascii_letters])) for _ in range(r.randrange(16, 40)))
    return drawn_secret(r)


def drawn_code(r: random.Random) -> str:
    """Tokens of pages and programs: addresses with paths, files, versions, names in code, formulas, times."""
    word = lambda: "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") + r.choice(["", "", "n", "r", "st", "ng", "l"]) for _ in range(r.randrange(1, 4)))
    number = lambda a, b: str(r.randrange(10**a, 10**b))
    date = f"{r.randrange(1990, 2030)}{r.randrange(1, 13):02d}{r.randrange(1, 29):02d}"
    ending = r.choice(["jpg", "png", "pdf", "html", "tar.gz", "js", "css", "csv", "py", "java", "mp4", "zip", "xml"])
    host = r.choice(["//www.", "//", "www.", ""]) + word() + r.choice([".com", ".org", ".net", ".co.uk", ".de", ".io"])
    joined = "".join(word().capitalize() for _ in range(r.randrange(2, 7)))
    return r.choice([
        lambda: host + "/" + "/".join(r.choice([word(), number(1, 4), f"{word()}-{word()}", date[:4]]) for _ in range(r.randrange(1, 6))) + r.choice(["", "/", f".{ending}", f"?{word()}", f"#{word()}"]),
        lambda: r.choice(["IMG", "DSC", "scan", word()]) + r.choice("_-") + date + r.choice(["", f"_{number(5, 6)}", f"-{number(1, 4)}"]) + f".{ending}",
        lambda: f"{word()}{r.choice('_-.')}{number(0, 4)}.{ending}", lambda: f"{word()}-{number(0, 2)}.{number(0, 2)}.{number(0, 2)}.{ending}",
        lambda: r.choice(["v", "", "V"]) + f"{number(0, 2)}.{number(0, 2)}.{number(0, 2)}" + r.choice(["", "-rc" + number(0, 1), "-beta." + number(0, 1), f"+build.{date}", f"-rc{number(0, 1)}+build.{date}", "-SNAPSHOT"]),
        lambda: joined + r.choice(["", "", number(0, 2)]), lambda: joined[0].lower() + joined[1:] + r.choice(["", number(0, 2)]), lambda: "_".join(word() for _ in range(r.randrange(2, 6))) + r.choice(["", "_" + number(0, 3)]),
        lambda: "_".join(word().upper() for _ in range(r.randrange(2, 5))), lambda: ".".join(word() for _ in range(r.randrange(3, 6))) + r.choice(["", "." + joined]), lambda: r.choice(["self.", "this.", "std."]) + f"{word()}_{word()}",
        lambda: "".join(r.choice(["C", "H", "O", "N", "Na", "Cl", "Fe", "Mg", "Ca", "K", "S", "P"]) + r.choice(["", "2", "3", "4", "6", "12", "22"]) for _ in range(r.randrange(3, 9))),
        lambda: f"{date[:4]}-{date[4:6]}-{date[6:]}T{number(1, 2)}", lambda: f"{date[:4]}/{date[4:6]}/{date[6:]}", lambda: f"{word()}{number(1, 2)}_{number(1, 2)}-{word()}-{word()}", lambda: f"--{word()}-{word()}",
        lambda: f"{r.choice('ABCDEFGH')}{number(0, 3)}-{number(2, 5)}/{number(1, 2)}", lambda: f"{number(2, 4)}x{number(2, 4)}", lambda: f"/{word()}/{word()}/{word()}-{number(0, 2)}/{word()}.{ending}",
        lambda: f"ISBN-{number(2, 3)}-{number(0, 1)}-{number(3, 4)}-{number(3, 4)}-{number(0, 1)}", lambda: f"{number(0, 3)},{number(2, 3)}.{number(1, 2)}", lambda: f"{word()}@{number(0, 2)}.{number(0, 2)}.{number(0, 2)}", lambda: f"#{word()}{number(0, 3)}",
    ])()


def drawn_plain(r: random.Random) -> str:
    """A token that is no secret though it isn't a plain word: numbers, dates, addresses, paths, codes, long or joined words, signs."""
    if r.random() < 0.5:
        return drawn_code(r)
    letters = r.choice([string.ascii_lowercase, string.ascii_lowercase + "àáäçèéêíñóöùúüß" * 2])
    syllable = lambda: "".join(r.choice(letters) for _ in range(r.randrange(1, 5)))
    word = lambda n=4: "".join(syllable() for _ in range(r.randrange(1, n)))
    number = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    made = r.choice([
        lambda: number(r.randrange(1, 20)), lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: "-".join(number(r.randrange(2, 5)) for _ in range(r.randrange(2, 5))),
        lambda: ".".join(number(r.randrange(1, 4)) for _ in range(4)), lambda: f"{word()}.{word()}@{word()}.{word(2)}", lambda: f"{word()}{number(2)}@{word()}{number(1)}.example.com",
        lambda: "/".join(word() for _ in range(r.randrange(2, 6))), lambda: f"www.{word()}.{word(2)}/{word()}-{word()}", lambda: "-".join(word() for _ in range(r.randrange(2, 6))),
        lambda: "_".join(word() for _ in range(r.randrange(2, 5))), lambda: "".join(word().capitalize() for _ in range(r.randrange(2, 4))), lambda: word().upper() + number(r.randrange(1, 5)),
        lambda: word(9), lambda: word(9).capitalize(), lambda: word(7).upper(), lambda: f"{word()}{number(r.randrange(1, 5))}", lambda: f"+{number(2)}-{number(3)}-{number(4)}",
        lambda: r.choice("-=*_.~#") * r.randrange(3, 40), lambda: f"{word()}.{word()}", lambda: syllable() * r.randrange(4, 9), lambda: "-".join("".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)),
    ])()
    return made + (r.choice(["!!", "***", "$$$", "###", "%%%", "&&&", ".", "...", ".***", ".&&&"]) if r.random() < 0.4 else "")


@lru_cache(maxsize=1)
def drawn_tokens() -> tuple[list[str], list[str], list[str]]:
    """Signatures of ``DRAWN`` secrets, of as many tokens that are none, and of values behind a naming word; the same in every task."""
    r = random.Random(1)
    whole = lambda t: len(TOKEN.findall(t)) == 1
    return tuple([signature(t) for t in (draw(r) for _ in range(DRAWN)) if whole(t)] for draw in (drawn_secret, drawn_plain, drawn_short))


def training_windows(docs: DataFrame, windows: int = CLEAN_WINDOWS) -> DataFrame:
    """(key, marked, features, tags): windows around the secrets that the patterns find, and others by hash.

    A secret's window comes as it is, without the naming words, without
    them but with values drawn from other alphabets (:func:`drawn_secret`), so
    that the shape of a value counts without its name, and with other naming words before values that
    may be short (:func:`drawn_short`).  A clean window comes as
    it is and with drawn tokens that are no secrets (:func:`drawn_plain`), beside naming words too.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["key", "marked", "features", "tags"]
        for frame in batches(frames, 128):
            rows = []

            def keep(signs: dict[int, str], part: range, n: int, whole: list[int], tags: np.ndarray) -> None:
                found = window_slots(signs, part, n, whole)
                key = zlib.crc32(np.asarray(found, np.int32).tobytes())
                rows.append((key, bool(tags.any()), found, tags.tolist()))  # noqa: B023

            for text in frame["text"]:
                tokens = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text)]
                if not tokens:
                    continue
                parts = secret_parts(text, base_spans(text))
                tags = np.zeros(len(tokens), int)
                starts, ends = [s for _, s, _ in tokens], [e for _, _, e in tokens]
                for a, b in parts:
                    first = bisect_right(ends, a)
                    for i in range(first, bisect_left(starts, b)):
                        if tags[i] == OUT:
                            tags[i] = BEGIN if i == first else IN
                secret = np.flatnonzero(tags == BEGIN)
                seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                last = max(1, len(tokens) - WINDOW + 1)
                begin = [max(0, min(i - WINDOW // 2, last - 1)) for i in secret] + [(seed * (k + 1) * 2654435761 >> 7) % last for k in range(windows)]
                whole = slots("file", file_features(text, len(tokens)))
                for s in dict.fromkeys(begin):
                    part = range(s, min(s + WINDOW, len(tokens)))
                    signs = {i: signature(tokens[i][0]) for i in range(max(0, s - 1), min(part.stop + 1, len(tokens)))}
                    own, r = tags[s : part.stop], random.Random(seed + int(s))
                    keep(signs, part, len(tokens), whole, own)
                    if own.any():
                        # again without the names, so that a secret's own shape counts
                        bare = {i: "xxxx" if named(sign) else sign for i, sign in signs.items()}
                        keep(bare, part, len(tokens), whole, own)
                        for _ in range(REDRAWN):
                            keep(bare | {i: r.choice(drawn_tokens()[0]) for i in part if tags[i] != OUT}, part, len(tokens), whole, own)
                        for _ in range(HINTED):
                            hints = {i - 1: r.choice(HINTS) for i in part if tags[i] == BEGIN and i and tags[i - 1] == OUT}
                            keep(bare | hints | {i: r.choice(drawn_tokens()[2]) for i in part if tags[i] != OUT}, part, len(tokens), whole, own)
                    else:
                        for _ in range(REDRAWN_CLEAN):
                            told = {i: r.choice(drawn_tokens()[1]) for i in r.sample(part, min(len(part), 5))}
                            # naming words also stand where no secret follows
                            keep(signs | {i: r.choice(HINTS) for i in r.sample(part, min(len(part), 2))} | told, part, len(tokens), whole, own)
                    if len(rows) >= KEPT_WINDOWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, "key long, marked boolean, features array<int>, tags array<int>")


def fit_field(features: list[np.ndarray], tags: list[np.ndarray]) -> Field:
    """Maximum likelihood with a ridge, by forward-backward over batches of windows and Adam."""
    n = len(features)
    size = np.array([len(t) for t in tags], int)
    x = np.zeros((n, WINDOW, PER_TOKEN), np.int32)
    y = np.zeros((n, WINDOW), int)
    for i, (f, t) in enumerate(zip(features, tags)):
        x[i, : size[i]], y[i, : size[i]] = np.reshape(f, (-1, PER_TOKEN)), t
    theta = [np.zeros((WIDTH, 3)), np.zeros((3, 3)), np.zeros(3)]
    m1, m2 = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    order = np.random.RandomState(7).permutation(n)
    if not n or not (y > 0).any():
        return Field(theta[0], theta[1], np.array([0.0, -1e6, -1e6]))
    # Windows with a secret are in every step, or in turn if they are more than a step's; the others in turn.
    secret = (y > 0).any(1)
    marked, plain = order[secret[order]], order[~secret[order]]
    for t in range(1, STEPS + 1):
        some = np.arange((t - 1) * STEP_ROWS, t * STEP_ROWS)
        at = np.r_[marked[some[: len(marked)] % len(marked)], plain[some[: max(len(plain), 1)] % len(plain)] if len(plain) else plain]
        grad = gradient(theta, x[at], y[at], size[at])
        for p, g, a, b in zip(theta, grad, m1, m2):
            g = g / size[at].sum() + RIDGE * p
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p -= 0.1 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-9)
    return Field(*theta)


def gradient(theta: list[np.ndarray], x: np.ndarray, y: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Of the negative log likelihood of a batch: expected minus seen counts."""
    w, steps, start = theta
    n, length = y.shape
    there = np.arange(length) < size[:, None]
    emit = w[x].sum(2)
    # a window with a secret counts as much as several without, for there are few
    heavy = np.where((y * there > 0).any(1), SECRET_WEIGHT, 1.0)

    def lse(v: np.ndarray, axis: int) -> np.ndarray:
        top = v.max(axis, keepdims=True)
        return (top + np.log(np.exp(v - top).sum(axis, keepdims=True))).squeeze(axis)

    alpha, beta = np.zeros((n, length, 3)), np.zeros((n, length, 3))
    alpha[:, 0] = start + emit[:, 0]
    for k in range(1, length):
        alpha[:, k] = np.where(there[:, k, None], lse(alpha[:, k - 1, :, None] + steps, 1) + emit[:, k], alpha[:, k - 1])
    for k in range(length - 2, -1, -1):
        beta[:, k] = np.where(there[:, k + 1, None], lse(steps + (emit[:, k + 1] + beta[:, k + 1])[:, None, :], 2), 0)
    z = lse(alpha[:, -1], 1)
    mark = np.exp(alpha + beta - z[:, None, None]) * there[..., None]
    diff = mark.copy()
    rows, cols = np.nonzero(there)
    diff[rows, cols, y[rows, cols]] -= 1
    diff *= heavy[:, None, None]
    flat, d = x[rows, cols].ravel(), np.repeat(diff[rows, cols], x.shape[2], axis=0)
    gw = np.stack([np.bincount(flat, d[:, c], WIDTH) for c in range(3)], 1)
    gs = np.zeros((3, 3))
    for k in range(1, length):
        on = there[:, k]
        pair = np.exp(alpha[on, k - 1, :, None] + steps + (emit[on, k] + beta[on, k])[:, None, :] - z[on, None, None])
        gs += (pair * heavy[on, None, None]).sum(0)
        np.subtract.at(gs, (y[on, k - 1], y[on, k]), heavy[on])
    return [gw, gs, diff[:, 0].sum(0)]


class Tagger:
    """A field with what a worker has already summed up for the tokens it has met."""

    def __init__(self, field: Field):
        self.field = field
        self.kept: dict[str, int] = {}  # of tokens
        self.signs: dict[str, int] = {}  # of signatures
        self.sums = np.zeros((1024, 9))
        w = field.weights
        self.edge = np.r_[w[EDGE["before"]].sum(0), w[EDGE["after"]].sum(0)]
        #: A token whose margin for OUT is over this is OUT on every best path: two steps can't make it up.
        self.sure = 2 * (max(field.steps.max(), field.start.max()) - min(field.steps.min(), field.start.min()))

    def rows(self, tokens: list[str]) -> np.ndarray:
        kept, signs = self.kept, self.signs
        if len(kept) > KEPT_TOKENS:
            kept.clear()
            signs.clear()
        for t in {t for t in tokens if t not in kept}:
            sign = signature(t)
            if sign not in signs:
                k = signs[sign] = len(signs)
                if k >= len(self.sums):
                    self.sums = np.r_[self.sums, np.zeros_like(self.sums)]
                self.sums[k] = np.concatenate([self.field.weights[s].sum(0) for s in token_slots(sign)])
            kept[t] = signs[sign]
        return self.sums[list(map(kept.__getitem__, tokens))]

    def tags(self, text: str, tokens: list[str]) -> np.ndarray:
        """The best sequence of states.

        Between tokens that are OUT on every best path the stretches are decoded
        one by one; most texts have none.
        """
        if not tokens:
            return np.zeros(0, int)
        r = self.rows(tokens)
        emit = r[:, :3] + self.field.weights[slots("file", file_features(text, len(tokens)))].sum(0)
        emit[1:] += r[:-1, 3:6]
        emit[0] += self.edge[:3]
        emit[:-1] += r[1:, 6:]
        emit[-1] += self.edge[3:]
        out = np.zeros(len(tokens), int)
        open_at = np.flatnonzero(emit[:, OUT] - emit[:, 1:].max(1) <= self.sure)
        if not len(open_at):
            return out
        for part in np.split(open_at, np.flatnonzero(np.diff(open_at) > 1) + 1):
            a, b = part[0], part[-1] + 1
            out[a:b] = self.viterbi(emit[a:b], a == 0, b == len(tokens))
        return out

    def viterbi(self, emit: np.ndarray, first: bool, last: bool) -> list[int]:
        """Best states of a stretch; before and after it stands OUT, or the text ends."""
        steps = self.field.steps
        best = emit[0] + (self.field.start if first else steps[OUT])
        back = []
        for e in emit[1:]:
            ways = best[:, None] + steps
            back.append(ways.argmax(0))
            best = ways.max(0) + e
        if not last:
            best = best + steps[:, OUT]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans of the field that touch no base span."""
        tags = self.tags(text, TOKEN.findall(text))
        if not tags.any():
            return []
        spans: list[list[int]] = []
        for tag, m in zip(tags, TOKEN.finditer(text)):
            if tag == BEGIN or (tag == IN and (not spans or spans[-1][2])):
                spans.append([m.start(), m.end(), 0])
            elif tag == IN:
                spans[-1][1] = m.end()
            elif spans:
                spans[-1][2] = 1  # closed
        # where the base spans that begin before a place end at the latest
        starts, reach = [s for _, s, _ in base], [0]
        for _, _, e in base:
            reach.append(max(reach[-1], e))
        return [("crf", a, b) for a, b, _ in spans if b - a >= LEAST_ADDED and reach[bisect_left(starts, b)] <= a]


def train(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS) -> Field:
    """Fit on a bounded sample, tagged by the fixed patterns.

    Whole texts of ``fit_docs`` documents make windows; of those with a secret
    ``fit_windows`` reach the driver, and as many without.  Null and empty texts
    make none, repeated rows make theirs again; without any secret the field adds nothing.
    """
    chosen = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # fit_docs ids at most
    made = materialise(training_windows(sample), "windows")
    parts = [made.where(F.col("marked") == m).orderBy("key", "features").limit(fit_windows) for m in (True, False)]
    rows = reduce(DataFrame.unionAll, parts).select("features", "tags").toPandas()
    drop_table(made)
    windows = [(np.asarray(f, np.int32), np.asarray(t, int)) for f, t in zip(rows["features"], rows["tags"])]
    keyed = sorted(((f.tobytes(), f, t) for f, t in windows), key=lambda x: x[0])
    return fit_field([f for _, f, _ in keyed], [t for _, _, t in keyed])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan_secrets(docs: DataFrame, field: Field) -> DataFrame:
    """Spans of secrets in every whole text.

    ``docs`` needs doc_id and text.  Returns doc_id, n_assign, n_access, n_hex,
    base_sha256 (of the fixed patterns' spans), spans ("kind:start:end" of all,
    in code points, end exclusive, by start), found (the spans as an array).  The field adds
    spans of the kind "crf", of ``LEAST_ADDED`` characters or more, where no fixed pattern matches.

    Null and empty texts have no spans; repeated rows give repeated results; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # WIDTH * 3 numbers
    columns = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]

    def start():
        tagger = Tagger(shared.value)

        def scan(texts: list[str | None]) -> dict[str, list]:
            rows = []
            for text in texts:
                text = text or ""
                base = base_spans(text)
                n = Counter(k for k, _, _ in base)
                spans = sorted(base + tagger.added(text, base), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((n["assign"], n["access"], n["hex"], digest, joined(spans), [{"kind": k, "start": a, "stop": b} for k, a, b in spans]))
            return {c: [r[k] for r in rows] for k, c in enumerate(columns)}

        return scan

    return map_texts(docs, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:int,stop:int>>", start)
