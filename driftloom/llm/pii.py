"""Operator 5: personal data by patterns and by a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field is trained by conditional likelihood on a small labelled table of short
sentences (``training_table`` unless another is given), which shows personal data in forms that the patterns miss and
secrets (a kind of its own) that are assigned to a name, beside numbers that are none: dates, prices, versions, keys. Its
spans are added where they touch no base span; base spans stay. Nothing is filtered after the field: check digits, byte
values and the digits of a run of numbers are features of its words.

The field is constrained: a word that has no digit, at sign or bracketed "at" or "dot", and has no such word beside it,
can only be ordinary. So a text falls into runs between those words, each is decoded exactly, and all runs of an Arrow
batch go through Viterbi side by side.

Defined results: a null or empty text has no spans; ids are carried, null or repeated; an empty table gives no rows;
``redact`` carries other columns. Memory is one Arrow batch and what a few megabytes of its texts need.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, spread, table
from .tokens import steps

KINDS = ("email", "ip", "card", "phone", "secret")
#: The kinds that the patterns find.
BASE_KINDS = KINDS[:4]
#: A start inside a run of digits never matches where the run's start doesn't, so runs are entered at their start only.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPECIAL = re.compile(r"[0-9@]|[\[({<](?:at|dot)[\])}>]", re.IGNORECASE)


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = [2 * int(c) for c in digits[-2::-2]]
    return (sum(map(int, odd)) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> list[tuple[int, int]]:
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > past and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append((begin, found.end()))
        past = found.end() if found else at + 1
        at = text.find("@", past)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) in order; code points."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = _digits(m[0])
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# ---- the field ----

_SHAPES = [(re.compile(p), s) for p, s in ((r"[A-Z]", "X"), (r"[a-z]", "x"), (r"[0-9]", "d"), (r"[^\x00-\x7F]", "u"))]
_CUES = re.compile(r"^[(\"'*]*(phone|tel|telephone|call|fax|mobile|cell|whatsapp|e-?mail|mail|contact|card|visa|mastercard|ip|host|address|server|token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth|bearer)[.:,=)\"'*]*$", re.IGNORECASE)
_SECRETS = {"token", "password", "passwd", "pwd", "secret", "apikey", "api_key", "accesskey", "access_key", "auth", "bearer"}
_ASSIGNED = re.compile(r"(token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth)[\"']?[:=]", re.IGNORECASE)
_AT = re.compile(r"[\[({<](at|dot)[\])}>]", re.IGNORECASE)
_GROUP = re.compile(r"[+(]?[0-9][0-9().\-/]*[.,;:!?\"']*")
_EDGE = ".,;:!?\"'#*$%&|"


@lru_cache(maxsize=1 << 16)
def _features(word: str) -> tuple[str, ...]:
    if not _SPECIAL.search(word):
        cue = _CUES.match(word) if len(word) < 24 else None
        if cue:
            name = cue[1].lower().replace("-", "")
            return ("plain", "cue=" + ("secret" if name in _SECRETS else name))
        return ("plain", "equals") if word in ("=", ":", ":=", "=>") else ("plain",)
    core = word.strip(_EDGE)
    shape = core
    for pattern, sign in _SHAPES:
        shape = pattern.sub(sign, shape)
    short = re.sub(r"(.)\1+", r"\1", shape)
    digits = _digits(core)
    n = len(digits)
    out = ["special", "short=" + short[:12], f"digits={min(n, 20)}", "head=" + shape[:1], "at" if "@" in core else "no at"]
    if re.fullmatch(r"[d().+/-]+", shape) and n:
        groups = re.findall("[0-9]+", core)
        out.append("groups=" + ",".join(map(str, map(len, groups)))[:16])
        if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
            out.append("bytes")
    if re.search(r"@[\w-]+(\.|[\[({<]dot)", core) or re.search(r"[\[({<]at[\])}>][\w-]+(\.|[\[({<]dot)", core, re.IGNORECASE):
        out.append("domain")
    if _AT.search(word):
        out.append("spelt")
    if len(core) >= 12 and re.fullmatch(r"[\w./+=-]+", core):
        out += [f"long={min(len(core) // 8, 8)}", "hex" if re.fullmatch("[0-9a-fA-F]+", core) else "mixed"]
        if n == len(core):
            out.append("number")
    if _ASSIGNED.search(word):
        out.append("assigned")
    return tuple(out)


def features(word: str) -> tuple[str, ...]:
    """Features of a whole word's shape; those of words that aren't long are kept."""
    return _features(word) if len(word) <= 256 else _features.__wrapped__(word)


def marks(words: list[str]) -> list[tuple[str, ...]]:
    """Features of the run of digit groups that each word is part of: its digits in all, and whether their check digit holds."""
    out: list[tuple[str, ...]] = [()] * len(words)
    i = 0
    while i < len(words):
        j = i
        while j < len(words) and _GROUP.fullmatch(words[j]):
            j += 1
        if j > i:
            digits = "".join(map(_digits, words[i:j]))
            n = len(digits)
            own = (f"run={min(n, 20)}", f"run words={min(j - i, 6)}", *(("run check" if luhn(digits) else "run no check",) if 12 <= n <= 19 else ()))
            out[i:j] = [own] * (j - i)
        i = max(j, i + 1)
    return out


def _fill(sentence: str, kinds: dict[str, str]) -> tuple[list[str], list[int]]:
    words, labels = [], []
    for part in sentence.split(" "):
        kind = part.strip(".,;:!?()\"'")
        body = part.replace(kind, kinds[kind]) if kind in kinds else part
        for w in body.split():
            words.append(w)
            name = "secret" if kind == "ASSIGNED" else kind.lower()
            labels.append(1 + KINDS.index(name) if kind in kinds and name in KINDS else 0)
    return words, labels


def _card(random: np.random.Generator) -> str:
    body = "".join(map(str, random.integers(0, 10, 15)))
    body = str(random.integers(3, 7)) + body[1:]
    return next(body + c for c in "0123456789" if luhn(body + c))


def training_table(size: int = 900, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Labelled sentences: (words, labels), 0 for an ordinary word, else 1 + the index in KINDS."""
    random = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, random.integers(0, 10, n)))
    name = lambda: "".join(random.choice(list("abcdefghilmnoprstuv"), random.integers(3, 9)))
    pick = lambda *x: x[random.integers(len(x))]
    frames = [
        "X X X EMAIL X X.", "contact: EMAIL X X", "write to EMAIL, X or PHONE X", "X email EMAIL.", "X X IP X X", "server IP X X.", "X card CARD X X", "visa: CARD, X X", "call PHONE X X.", "tel: PHONE X X", "phone PHONE, X X", "X X PHONE X",
        "X DATE X X DATE2.", "X on DATE X PRICE X", "version VERSION X X", "X X VERSION, X PLAIN X", "X PLAIN X PLAIN2 X", "X HEX X X", "X PRICE, X PRICE2 X.", "X TIME X X TIME2", "X MENTION X X", "PLAIN X X PLAIN2.", "SECRETNAME = SECRET X X", "X SECRETNAME: SECRET, X", "X ASSIGNED X", "X SIXTEEN X X", "X X SIXTEEN.", "card SIXTEEN X", "X = PLAIN X", "X = HEX X", "id = HEX X", "X SECRETNAME X X", "id PLAIN X HEX X", "X PART X PART2 X", "X X X X X X.", "call X X PLAIN", "X card X PLAIN X", "X at X dot X X", "X PLAIN PLAIN2 X X", "X | DATE | X | PRICE |", "server VERSION X X", "X ORDER X X", "order ORDER X", "phone X X DATE",
    ]
    out = []
    for _ in range(size):
        user, host = name() + pick("", ".", "_") + pick("", digits(2), name()), name() + pick("", digits(1)) + "." + pick("example", name()) + "." + pick("com", "org", "net", "de", "fr")
        user = user.strip("._")
        c = _card(random)
        area, mid, end = digits(3), digits(3), digits(4)
        hexes, mixed = (lambda: "".join(random.choice(list("0123456789abcdef"), pick(16, 32, 40, 64)))), (lambda: pick("sk_live_", "ghp_", "AKIA", "") + "".join(random.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789"), pick(16, 24, 36))) + digits(1))
        secret, named = pick(hexes(), hexes().upper(), mixed()), pick("token", "password", "secret", "api_key", "TOKEN", "access_key", "apikey", "pwd")
        sixteen = digits(pick(13, 15, 16, 16, 16))
        sixteen = sixteen if not luhn(sixteen) else sixteen[:-1] + str((int(sixteen[-1]) + 1) % 10)
        kinds = {
            "SECRETNAME": named, "SECRET": pick(f'"{secret}"', secret, f"'{secret}'", f'"{secret}"###', f'"{secret}"!!'), "ASSIGNED": pick(f"{named}={secret}", f'{named}="{secret}"', f"{named}:{secret}"),
            "SIXTEEN": pick(sixteen, sixteen, f"{sixteen[:4]} {sixteen[4:8]} {sixteen[8:12]} {sixteen[12:]}", f"{sixteen[:4]}-{sixteen[4:8]}-{sixteen[8:12]}-{sixteen[12:]}"),
            "EMAIL": pick(f"{user}@{host}", f"{user}(at){host}", f"{user}[at]{host}", f"{user} (at) {host}", f"{user} [at] {host.split('.')[0]} [dot] com", f"{user}[at]{name()}[dot]org", f"{user}@{name()}", f"{user} @ {host}"),
            "IP": pick(".".join(str(random.integers(0, 256)) for _ in range(4)), ".".join(str(random.integers(0, 256)) for _ in range(4)) + f":{digits(4)}", ".".join(str(random.integers(0, 256)) for _ in range(3)) + "[.]" + str(random.integers(0, 256))),
            "CARD": pick(c, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}", f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}"),
            "PHONE": pick(f"+1 ({area}) {mid}-{end}", f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"({area}){mid}-{end}", f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}", f"{area}.{mid}.{end}", f"1-{area}-{mid}-{end}", f"+{digits(11)}"),
            "DATE": pick(f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"1{digits(1)}/0{digits(1)}/20{digits(2)}", f"1{digits(1)}.0{digits(1)}.20{digits(2)}", f"20{digits(2)}"), "DATE2": pick(f"20{digits(2)}-1{digits(1)}-2{digits(1)}", f"19{digits(2)}"),
            "PRICE": pick(f"${digits(2)}.{digits(2)}", f"{digits(1)},{digits(3)}.{digits(2)}", f"{digits(2)}%", f"{digits(3)},{digits(3)},{digits(3)}"), "PRICE2": f"€{digits(3)}",
            "VERSION": pick(f"{digits(1)}.{digits(1)}", f"v{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(1)}.0-beta{digits(1)}"), "HEX": "".join(random.choice(list("0123456789abcdef"), pick(8, 16, 32, 40))),
            "PLAIN": pick(digits(1), digits(2), digits(3), digits(5), digits(7), digits(8), digits(10), digits(11)), "PLAIN2": pick(digits(1), digits(2), digits(4), digits(6), digits(9)), "TIME": f"1{digits(1)}:{digits(2)}", "TIME2": f"0{digits(1)}:{digits(2)}:{digits(2)}",
            "MENTION": pick("@" + name(), "(2nd)", "(a)", "x2", "@", "H2O", "CO2", "mp3", "1st", "3D"), "PART": f"{name().upper()[:2]}-{digits(4)}", "PART2": f"{digits(2)}x{digits(2)}", "ORDER": pick(f"#{digits(6)}", f"{digits(4)}-{digits(4)}", f"{digits(3)}/{digits(4)}", f"{digits(5)}-{digits(2)}", f"{digits(13)}", f"{digits(20)}", f"0.{digits(9)}"),
        }
        frame = frames[random.integers(len(frames))]
        words, labels = _fill(frame, kinds)
        out.append(([name() + w[1:] if w.startswith("X") and len(w) <= 2 else w for w in words], labels))
    return out


class Field:
    """Weights of a linear-chain conditional random field: features of the word itself and its run of numbers, and of the
    word before it, the one before that, and the one after it."""

    def __init__(self, labelled: list[tuple[list[str], list[int]]], rounds: int = 160, rate: float = 0.1, decay: float = 2e-4):
        near = {f for words, _ in labelled for w in words for f in features(w)}
        own = {f for words, _ in labelled for m in marks(words) for f in m}
        names = sorted({(at, f) for f in near for at in (0, -1, -2, 1)} | {(0, f) for f in own} | {(at, "edge") for at in (-1, -2, 1)})
        self.index = {n: i for i, n in enumerate(names)}
        self.k = 1 + len(KINDS)
        self.own = np.zeros((len(names), self.k))
        self.move = np.zeros((self.k, self.k))
        self._train(labelled, rounds, rate, decay)

    def _slots(self, word: str | None, at: int) -> list[int]:
        names = [(at, f) for f in features(word)] if word is not None else [(at, "edge")]
        return [self.index[n] for n in names if n in self.index]

    def slots(self, words: list[str | None], i: int, run: tuple[str, ...]) -> list[int]:
        """Features of words[i]; None stands for a text's edge, as does what lies beyond the list."""
        at = lambda d: words[i + d] if 0 <= i + d < len(words) else None
        return self._slots(at(0), 0) + [self.index[0, f] for f in run if (0, f) in self.index] + self._slots(at(-1), -1) + self._slots(at(-2), -2) + self._slots(at(1), 1)

    def emissions(self, words: list[str | None], first: int, last: int) -> np.ndarray:
        """Weights of the labels of words[first:last]; the words around them are context."""
        runs = marks([w or "" for w in words])
        return np.stack([self.own[self.slots(words, i, runs[i])].sum(axis=0) for i in range(first, last)])

    def _train(self, labelled: list[tuple[list[str], list[int]]], rounds: int, rate: float, decay: float) -> None:
        longest, n = max(len(w) for w, _ in labelled), len(labelled)
        rows, cols = [], []
        gold, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (words, labels) in enumerate(labelled):
            gold[i, : len(words)], real[i, : len(words)] = labels, True
            runs = marks(words)
            for t in range(len(words)):
                s = self.slots(words, t, runs[t])
                rows += [i * longest + t] * len(s)
                cols += s
        rows, cols = np.array(rows), np.array(cols)
        one = np.eye(self.k)[gold] * real[..., None]
        both = real[:, 1:] & real[:, :-1]
        moved = np.einsum("nta,ntb,nt->ab", one[:, :-1], one[:, 1:], both)
        momentum = [np.zeros_like(self.own), np.zeros_like(self.move)]
        squares = [np.zeros_like(self.own), np.zeros_like(self.move)]
        for step in range(1, rounds + 1):
            emit = np.zeros((n * longest, self.k))
            np.add.at(emit, rows, self.own[cols])
            emit = np.exp(emit.reshape(n, longest, self.k))
            move = np.exp(self.move)
            fwd, scale = np.zeros_like(emit), np.ones((n, longest))
            bwd = np.ones_like(emit)
            for t in range(longest):
                a = emit[:, t] * (fwd[:, t - 1] @ move if t else 1)
                scale[:, t] = a.sum(axis=1)
                fwd[:, t] = np.where(real[:, t, None], a / scale[:, t, None], fwd[:, t - 1] if t else 1)
            for t in range(longest - 2, -1, -1):
                b = (emit[:, t + 1] * bwd[:, t + 1] / scale[:, t + 1, None]) @ move.T
                bwd[:, t] = np.where(real[:, t + 1, None], b, 1)
            post = fwd * bwd * real[..., None]
            pair = np.einsum("nta,ntb,nt->ab", fwd[:, :-1], emit[:, 1:] * bwd[:, 1:] / scale[:, 1:, None], both) * move
            slope = np.zeros_like(self.own)
            np.add.at(slope, cols, (one - post).reshape(-1, self.k)[rows])
            for w, g, m, v in ((self.own, slope / n - decay * self.own, momentum[0], squares[0]), (self.move, (moved - pair) / n - decay * self.move, momentum[1], squares[1])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def decode(self, runs: list[np.ndarray], inside: list[tuple[bool, bool]]) -> list[np.ndarray]:
        """The best labels of each run of emissions; inside: whether an ordinary word stands before and after it."""
        order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
        lengths = np.array([len(runs[i]) for i in order])
        best, came = np.zeros((len(order), self.k)), []
        for t in range(lengths[0] if len(lengths) else 0):
            d = int(np.searchsorted(-lengths, -t, "left"))
            emit = np.stack([runs[i][t] for i in order[:d]])
            if t:
                ways = best[:d, :, None] + self.move
                came.append(ways.argmax(axis=1))
                best[:d] = ways.max(axis=1) + emit
            else:
                best[:d] = emit + self.move[0] * np.array([inside[i][0] for i in order[:d]])[:, None]
        best += self.move[:, 0] * np.array([inside[i][1] for i in order]).reshape(-1, 1)
        out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
        for row, i in enumerate(order):
            labels = [int(best[row].argmax())]
            for t in range(len(runs[i]) - 2, -1, -1):
                labels.append(int(came[t][row, labels[-1]]))
            out[i] = np.array(labels[::-1])
        return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, added spans) of each text, as (start, index of kind, end)."""
    bases: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs, inside, where = [], [], []
    for k, text in enumerate(texts):
        if not _SPECIAL.search(text):
            continue
        bases[k] = base_spans(text)
        words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        special = [i for i, (a, b) in enumerate(words) if _SPECIAL.search(text, a, b)]
        marked = sorted({x for i in special for x in (i - 1, i, i + 1) if 0 <= x < len(words)})
        i = 0
        while i < len(marked):
            j = i
            while j + 1 < len(marked) and marked[j + 1] == marked[j] + 1:
                j += 1
            a, b = marked[i], marked[j]
            near = [text[slice(*words[x])] if 0 <= x < len(words) else None for x in range(a - 2, b + 2)]
            runs.append(field.emissions(near, 2, len(near) - 1))
            inside.append((a > 0, b + 1 < len(words)))
            where.append((k, words[a : b + 1]))
            i = j + 1
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (k, words), labels in zip(where, field.decode(runs, inside), strict=True):
        i = 0
        while i < len(labels):
            j = i
            while j + 1 < len(labels) and labels[j + 1] == labels[i]:
                j += 1
            if labels[i]:
                text, (begin, end) = texts[k], (words[i][0], words[j][1])
                while begin < end and text[begin] in "\"'<,;:#*$%&|":
                    begin += 1
                while begin < end and text[end - 1] in "\"'>,;:.!?#*$%&|":
                    end -= 1
                if begin < end and not any(a < end and begin < b for a, _, b in bases[k]):
                    added[k].append((begin, int(labels[i]) - 1, end))
            i = j + 1
    return [(b, sorted(a)) for b, a in zip(bases, added, strict=True)]


@lru_cache(maxsize=2)
def default_field() -> Field:
    return Field(training_table())



def find(docs: DataFrame, field: Field | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end), base spans and all spans, in code points."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field or default_field())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
    shown = lambda x: [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in steps(b, "text")):
            found = all_spans([t or "" for t in batch.column("text").to_pylist()], sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shown(b) for b, _ in found], kind), pa.array([shown(sorted(b + a)) for b, a in found], kind)], ["doc_id", "base", "spans"])

    spans = "array<struct<start:long,kind:string,end:long>>"
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")


def redact(docs: DataFrame, field: Field | None = None, text_column: str = "text") -> DataFrame:
    """docs with every span of every text replaced by its kind in angle brackets; touching spans become the first one's."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field or default_field())

    def clean(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        out, past = [], 0
        for a, k, b in spans:
            if a >= past:
                out += [text[past:a], f"<{KINDS[k].upper()}>"]
            past = max(past, b)
        return "".join([*out, text[past:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in steps(b, text_column)):
            i = batch.schema.get_field_index(text_column)
            texts = batch.column(i).to_pylist()
            found = all_spans([t or "" for t in texts], sent.value)
            yield batch.set_column(i, batch.schema.field(i), pa.array([clean(t, sorted(b + a)) for t, (b, a) in zip(texts, found, strict=True)], batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spread(table(spark, sf_dir, "documents")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op5_pii": op5_pii}
ORACLES: dict[str, str] = {}
