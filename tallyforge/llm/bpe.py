"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

Whether two neighbouring bytes of a word end up in one token depends on a bounded number of bytes to the right. The
bound follows from the merge list alone. A merge (A, B) at a place needs B spelled there and B's right end left alone
by earlier merges; those that could take it away begin with a token that ends where B ends, which is one on the right
spine of B's own derivation. Hence reach(A, B) = |B| + max reach of the earlier merges (A', B') with A' on B's right
spine, computed in the order of the list, and the merge list's sufficient lookahead is the largest reach. Once that
many bytes beyond a token boundary are known, the boundary is final and the tokens before it can leave. This needs
each token to be made before it is merged further; a list for which that fails has no bound, and words are then kept
whole.

Every text goes in by pieces of FEED characters, and each token leaves under one rule: its right boundary is final, as
the word's end is known or the lookahead beyond it. The encoder therefore holds the tail of the open word, at most a
piece of text, and a bounded cache of words whose end is known.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, ship, utf8

FEED = 1 << 14
CACHE = 150_000
NEVER = 1 << 60
CLASSES = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
EASY = re.compile("[\x00-ɏ]*")


def _low_class(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)


_low = {"L": _low_class("L"), "N": _low_class("N"), "S": "\\t-\\r \\x85\\xa0"}
_any = {"L": "\\p{L}", "N": "\\p{N}", "S": SPACES}
SPLIT_EASY = re.compile(CLASSES.replace("{L}", _low["L"]).replace("{N}", _low["N"]).replace("{S}", _low["S"]))
SPLIT_ANY = regex.compile(CLASSES.replace("{L}", _any["L"]).replace("{N}", _any["N"]).replace("{S}", _any["S"]))
SPLIT_LETTER = regex.compile(r"\p{L}")
RUN = {"letters": regex.compile(r"\p{L}*"), "others": regex.compile(rf"[^{SPACES}\p{{L}}\p{{N}}]*")}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable in
    Latin-1, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: What this encoder does besides the merges, as tokenizer files say it; a file that asks for anything else is refused.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": CLASSES.format(L=r"\p{L}", N=r"\p{N}", S=r"\s")}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def refuse_others(spec: dict) -> None:
    """An error unless the file asks for just what this encoder does."""
    model = spec.get("model") or {}
    unlike = [k for k, want in (("normalizer", NORMALIZER), ("pre_tokenizer", PRE_TOKENIZER)) if spec.get(k) != want]
    unlike += [f"model.{k}" for k, want in MODEL.items() if model.get(k, want) != want]
    unlike += [f"added token {t.get('content')}" for t in spec.get("added_tokens", []) if any(t.get(k, v) != v for k, v in ADDED.items())]
    if (spec.get("decoder") or {}).get("type") not in (None, "ByteLevel"):
        unlike.append("decoder")
    if unlike:
        raise ValueError(f"not supported in this tokenizer file: {', '.join(unlike)}")


class Vocabulary:
    """A tokenizer file of kind BPE with its merge list, and what follows from it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_others(spec)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_level_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {m: i for i, m in reversed(list(enumerate(merges)))}
        self.tokens: list[str] = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.symbols = byte_symbols()
        self.lookahead = self._lookahead(merges)

    def _size(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def _lookahead(self, merges: list[tuple[str, str]]) -> int | None:
        """The sufficient lookahead in bytes, or None if the list has no bound."""
        made: dict[str, int] = {}
        spine: dict[str, set[str]] = defaultdict(set)
        reach: dict[str, int] = {}
        most = 1
        for i, (a, b) in enumerate(merges):
            for part in (a, b):
                if self._size(part) > 1 and part not in made:
                    return None
            own = self._size(b) + max((reach.get(t, 0) for t in {b} | spine[b]), default=0)
            reach[a] = max(reach.get(a, 0), own)
            most = max(most, own)
            made.setdefault(a + b, i)
            spine[a + b] |= {b} | spine[b]
        return most

    def merge(self, parts: list[str]) -> list[str]:
        """The tokens of a word's symbols: the earliest merge of the list first, the leftmost of its places first."""
        rank_of = self.ranks.get
        if len(parts) < 40:
            known = [rank_of(x, NEVER) for x in zip(parts, parts[1:])]
            while known and (least := min(known)) != NEVER:
                i = known.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del known[i]
                if i:
                    known[i - 1] = rank_of((parts[i - 1], parts[i]), NEVER)
                if i < len(known):
                    known[i] = rank_of((parts[i], parts[i + 1]), NEVER)
            return parts
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        live = [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j], after[i] = a + b, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank_of((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p, x in zip(parts, live) if x]

    def word(self, text: str) -> list[str]:
        parts = [self.symbols[b] for b in text.encode("utf-8", "surrogatepass")]
        if parts:
            parts[-1] += self.suffix
        return self.merge(parts)


def normalise(text: str) -> str:
    """NFC, then lower case character by character. White space only parts words, so it isn't rewritten."""
    if not EASY.fullmatch(text):
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form of sigma
    return text.lower()


class Words(dict):
    """The ids of whole words, found when first asked for. At most twice CACHE of them: those not asked for while CACHE
    others were are forgotten."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.v = vocabulary
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.older.get(word)
        if found is None:
            found = tuple(map(self.v.ids.__getitem__, self.v.word(word)))
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


class Encoder:
    """Text goes in by pieces of any size; ids come out as soon as they are final.

    ``fed`` and ``finished`` count the ids that came out of feed and of finish.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.words = Words(vocabulary)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.longest = max(map(len, vocabulary.special), default=1)
        self.fed = self.finished = 0
        self.reset()

    def reset(self) -> None:
        self.raw = ""  # not yet searched for special tokens, nor normalised
        self.text = ""  # normalised, not yet cut into words
        self.run: str | None = None  # the class of the word whose start has left already
        self.most_held = 0

    def feed(self, text: str) -> list[int]:
        self.raw += text
        out = self._specials()
        # the end may be the start of a special token, or combine with what follows
        at = self._safe(len(self.raw) - self.longest + 1)
        if at > 0:
            part, self.raw = self.raw[:at], self.raw[at:]
            out += self._words(part, False)
        self.most_held = max(self.most_held, len(self.raw) + len(self.text))
        self.fed += len(out)
        return out

    def finish(self) -> list[int]:
        out = self._specials()
        part, self.raw = self.raw, ""
        out += self._words(part, True)
        self.finished += len(out)
        return out

    def _specials(self) -> list[int]:
        out: list[int] = []
        while self.specials and (m := self.specials.search(self.raw)):
            out += self._words(self.raw[: m.start()], True)
            out.append(self.v.special[m[0]])
            self.raw = self.raw[m.end() :]
        return out

    def _safe(self, at: int) -> int:
        """The last place up to ``at`` before a character that never combines with what stands before it."""
        while at > 0:
            c = self.raw[at]
            if c < "̀" or unicodedata.category(c)[0] != "M" and not ("ᄀ" <= c <= "ᇿ" or "ힰ" <= c <= "퟿"):
                return at
            at -= 1
        return 0

    def _words(self, part: str, last: bool) -> list[int]:
        """The ids of words that can't grow any more, and of the open word's final tokens; with ``last`` all that is left."""
        text = self.text = self.text + normalise(part)
        at = 0
        out: list[int] = []
        if self.run:
            end = RUN[self.run].match(text).end()
            if end == len(text) and not last:
                return self._stable()
            out += map(self.v.ids.__getitem__, self.v.word(text[:end]))
            self.run, at = None, end
        split = SPLIT_EASY if EASY.fullmatch(text) else SPLIT_ANY
        known = len(text) if last else max(at, text.rfind(" ", at, -3))  # no word holds a space
        out += chain.from_iterable(map(self.words.__getitem__, split.findall(text, at, known)))
        self.text, self.run = text[known:], None
        if last:
            return out
        for m in split.finditer(self.text):
            # a word at the end may grow, and an apostrophe needs two more characters
            if m.end() > len(self.text) - 3:
                held = self.text[m.start() :]
                if m.end() == len(self.text) and self.v.lookahead is not None:
                    self.run = "letters" if SPLIT_LETTER.match(held) else "others" if RUN["others"].fullmatch(held) and (held[0] != "'" or len(held) > 2) else None
                self.text = held
                return out + self._stable() if self.run else out
            out += self.words[m[0]]
        self.text = self.text[-3:]
        return out

    def _stable(self) -> list[int]:
        """The ids of the open word's tokens that no further text can change. Its last symbol may yet turn into one that ends a word."""
        data = self.text.encode("utf-8", "surrogatepass")
        limit = len(data) - self.v.lookahead - 1
        if limit <= 0:
            if len(data) < self.v.lookahead:
                self.run = None  # none of it has left, so it is cut anew with what follows
            return []
        tokens = self.v.merge([self.v.symbols[b] for b in data])
        left = gone = cut = 0
        for i, t in enumerate(tokens):
            left += len(t)
            if left > limit:
                break
            if data[left] & 0xC0 != 0x80:  # a character ends here as well
                cut, gone = i + 1, left
        self.text = data[gone:].decode("utf-8", "surrogatepass")
        return list(map(self.v.ids.__getitem__, tokens[:cut]))

    def encode(self, text: str) -> list[int]:
        self.reset()
        out: list[int] = []
        for a in range(0, len(text), FEED):
            out += self.feed(text[a : a + FEED])
        return out + self.finish()


class Decoder:
    """Ids go in one at a time or many; text comes out as soon as it is final.

    Without a decoder in the file, tokens are written as they are with a space between two. ``as_bytes`` turns the
    byte symbols back into bytes instead, an end of word into a space, and bytes into text by an incremental UTF-8
    state machine, so that a character may be spread over tokens.
    """

    def __init__(self, vocabulary: Vocabulary, as_bytes: bool | None = None) -> None:
        self.v = vocabulary
        self.as_bytes = vocabulary.byte_level_decoder if as_bytes is None else as_bytes
        self.started = False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        if self.as_bytes:
            value = {s: bytes([b]) for b, s in enumerate(vocabulary.symbols)}
            self.bytes_of = [b"".join(value.get(c, c.encode()) for c in (t.removesuffix(vocabulary.suffix) if vocabulary.suffix else t)) + (b" " if vocabulary.suffix and t.endswith(vocabulary.suffix) else b"") for t in vocabulary.tokens]

    def feed(self, ids: Iterable[int]) -> str:
        if self.as_bytes:
            return self.utf8.decode(b"".join(map(self.bytes_of.__getitem__, ids)))
        text = " ".join(map(self.v.tokens.__getitem__, ids))
        if text and self.started:
            text = " " + text
        self.started |= bool(text)
        return text

    def finish(self) -> str:
        return self.utf8.decode(b"", True) if self.as_bytes else ""


_loaded: dict[str, tuple[Vocabulary, Encoder]] = {}


def loaded(path: str) -> tuple[Vocabulary, Encoder]:
    if path not in _loaded:
        v = Vocabulary(path)
        _loaded[path] = v, Encoder(v)
    return _loaded[path]


def digest(text: str, path: str) -> tuple[int, str, str]:
    """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text), both hashed piece by piece."""
    v, encoder = loaded(path)
    decoder, of_ids, of_text = Decoder(v), hashlib.sha256(), hashlib.sha256()
    encoder.reset()
    n = 0

    def take(ids: list[int]) -> None:
        nonlocal n
        if ids:
            of_ids.update(((" " if n else "") + " ".join(map(v.decimals.__getitem__, ids))).encode())
            of_text.update(decoder.feed(ids).encode("utf-8", "surrogatepass"))
            n += len(ids)

    for a in range(0, len(text), FEED):
        take(encoder.feed(text[a : a + FEED]))
    take(encoder.finish())
    of_text.update(decoder.finish().encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets, 4 << 20):
                rows = [digest(t or "", path) for t in batch.column("text").slice(a, b - a).to_pylist()]
                n, ids, text = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = loaded(path)
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets, 1 << 20):
                ids = [encoder.encode(t or "") for t in batch.column("text").slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return run


def _decode(path: str, as_bytes: bool | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _ = loaded(path)
        for batch in batches:
            out = []
            for ids in batch.column("ids").to_pylist():
                d = Decoder(v, as_bytes)
                out.append(None if ids is None else d.feed(ids) + d.finish())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "text"])

    return run


def _picked(df: DataFrame, id_col: str, col: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(col).alias(name))


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of each row's whole text. Null counts as empty and gives no ids; rows are kept as they are."""
    ship(docs.sparkSession)
    return _picked(docs, id_col, text_col, "text").mapInArrow(_encode(path), "id long, ids array<int>").withColumnRenamed("id", id_col)


def encode_with(docs: DataFrame, path: str, keep: list[str], *, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, n_tokens and ids of each row; nothing is joined."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            own = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text_col)], ["id", "text"])
            for part in _encode(path)(iter([own])):
                ids = part.column("ids")
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(ids)) for c in keep), ids.value_lengths().cast(pa.int64()), ids], [*keep, "n_tokens", "ids"])
                at += len(ids)

    fields = [docs.schema[c] for c in keep]
    more = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return docs.select(*keep, *[c for c in [text_col] if c not in keep]).mapInArrow(run, T.StructType([*fields, *more]))


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids", as_bytes: bool | None = None) -> DataFrame:
    """(id, text) from (id, ids); null ids give a null text. An id that the vocabulary lacks is an error."""
    ship(encoded.sparkSession)
    ids = _picked(encoded, id_col, ids_col, "ids")
    return ids.mapInArrow(_decode(path, as_bytes), "id long, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text, in constant memory beside the row itself.

    Null and empty texts have no tokens and the digests of nothing. Null and repeated ids are kept.
    """
    ship(docs.sparkSession)
    return _picked(docs, id_col, text_col, "text").mapInArrow(_digests(path), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
