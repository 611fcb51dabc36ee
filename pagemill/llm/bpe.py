"""BPE encoding and decoding by forced-boundary splitting.

A byte-level BPE merge can only ever build a token of the vocabulary. Two neighbouring start symbols that stand side by
side in no token can therefore never end up in one token: between them lies a certain cut. Each word is cut at all such
places, its fragments are encoded independently (and remembered), and the ids are concatenated.

Everything that isn't the merge itself - Unicode normalisation and word splitting - is asked of the vocabulary file's own
normalizer and pre-tokenizer, blank-delimited chunk by chunk; neither looks across a blank.

Defined results: a null text counts as empty and has no ids; null ids decode to an empty text; an empty table gives an empty
result; repeated rows give repeated results; a text of any length is encoded whole (a batch of texts is bounded by Spark's
spark.sql.execution.arrow.maxBytesPerBatch). encode() and decode() carry columns of any name; one that bears the name of the
new column gives way. digests() reads the two columns named and returns its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed bounds of a worker's memory of chunks and fragments: entries, and the longest one remembered in bytes.
MEMORY_ENTRIES, MEMORY_LENGTH = 150_000, 48

#: Characters that normalisation can only lower-case, each by itself: printable ASCII and the Latin blocks after it.
_PLAIN = re.compile("[!-~\u00a1-\u024f]+")
#: Fixed value: the splitting pattern of the word vocabularies.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS = regex.compile(_WORD_SPLIT)


def _byte_alphabet() -> dict[int, str]:
    """The usual byte alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_alphabet()
_WORKER: dict[str, "ForcedBoundaryBPE"] = {}


class ForcedBoundaryBPE:
    """Encoder and decoder of one tokenizers-format file of kind byte-level BPE with word ends."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        parsed = json.loads(spec)
        model = parsed["model"]
        if model["type"] != "BPE" or parsed.get("decoder") or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError("a deterministic BPE vocabulary without a decoder is needed")
        library = Tokenizer.from_str(spec)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        #: Whether plain characters may be split here, without asking the library.
        splits = (parsed["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        lowers = (parsed["normalizer"] or {}).get("normalizers", [])
        self.plain = {"type": "Lowercase"} in lowers and splits[0].get("pattern", {}).get("Regex") == _WORD_SPLIT
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.ids = vocab
        self.text = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        self.id_bytes = {i: b"%d " % i for i in self.text}
        self.text_bytes = {i: f"{t} ".encode() for i, t in self.text.items()}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in parsed["added_tokens"]):
            raise ValueError("added tokens must be plain")
        found = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.find_special = re.compile(f"({found})") if found else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: The merge rules for a word's last fragment, which bears the word end, and for those before it.
        self.last, self.inner = (BPE(vocab=vocab, merges=merges, **x) for x in ({"end_of_word_suffix": self.suffix} if self.suffix else {}, {}))
        #: Neighbours within a token, and those that close a word within one.
        self.together, self.closing = set(), set()
        for token in vocab:
            ended = bool(self.suffix) and token.endswith(self.suffix)
            plain = token[: -len(self.suffix)] if ended else token
            pairs = [plain[i : i + 2] for i in range(len(plain) - 1)]
            self.together.update(pairs[:-1] if ended else pairs)
            self.closing.update(pairs[-1:] if ended or not self.suffix else ())
        self.chunks: dict[bytes, tuple] = {}

    def cuts(self, word: str) -> list[str]:
        """The word's fragments between forced boundaries; the last one bears the word end."""
        end, together = len(word) - 1, self.together
        at = [i for i in range(1, end) if word[i - 1 : i + 1] not in together]
        if end > 0 and word[end - 1 :] not in self.closing:
            at.append(end)
        return [word[i:j] for i, j in zip([0, *at], [*at, None], strict=True)] if at else [word]

    def words(self, chunk: str) -> list[str]:
        """The split words of a blankless chunk in the vocabulary's byte alphabet."""
        if self.plain and _PLAIN.fullmatch(chunk):
            return [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES) for w in _WORDS.findall(chunk.lower())]
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    def _chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for word in self.words(chunk):
            *inner, last = self.cuts(word)
            for fragment in inner:
                out += [t.id for t in self.inner.tokenize(fragment)]
            out += [t.id for t in self.last.tokenize(last)]
        return out

    def chunk(self, chunk: bytes) -> tuple[int, bytes, bytes]:
        """(number of ids, ids in decimal each followed by a blank, tokens each followed by a blank) of a blankless chunk."""
        known = self.chunks.get(chunk)
        if known is None:
            text, ids = chunk.decode("utf-8"), []
            for i, part in enumerate(self.find_special.split(text) if self.find_special and self.find_special.search(text) else [text]):
                if i % 2:
                    ids.append(self.special[part])
                elif part:
                    ids += self._chunk_ids(part)
            known = (len(ids), b"".join([self.id_bytes[x] for x in ids]), b"".join([self.text_bytes[x] for x in ids]))
            if len(chunk) <= MEMORY_LENGTH:
                if len(self.chunks) >= MEMORY_ENTRIES:
                    self.chunks.clear()
                self.chunks[chunk] = known
        return known

    def encode(self, text: str) -> list[int]:
        return [int(x) for c in text.encode("utf-8").split() for x in self.chunk(c)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: tokens joined by blanks; unknown ids have no text."""
        return " ".join(self.text[i] for i in ids if i in self.text)


def _encoder(spec: str) -> ForcedBoundaryBPE:
    """One encoder a worker and vocabulary, kept between tasks."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = ForcedBoundaryBPE(spec)
    return _WORKER[key]


def read_spec(path: str) -> str:
    """A vocabulary file's text, read once on the driver; a file is at most a few MB and goes to the workers by broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """docs with one more column: the ids of the whole text."""
    if ids_col in docs.columns:
        docs = docs.drop(ids_col)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(spec.value)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, ids_col])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, vocabulary: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """docs with one more column: the text of the ids."""
    if text_col in docs.columns:
        docs = docs.drop(text_col)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))
    at = docs.columns.index(ids_col)
    schema = T.StructType([*docs.schema, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(spec.value)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every whole text: encode() and decode() without keeping the ids.

    Chunks are hashed as they come, so that a very long text needs no list of its ids.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))
    kept = docs.select(id_col, docs[text_col].cast("binary").alias("text"))
    schema = kept.select(id_col).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(spec.value)
        chunk, known, block = bpe.chunk, bpe.chunks, 4096
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for text in batch.column(1):
                parts = (text.as_py() or b"").split()
                n, ids, decoded, held = 0, hashlib.sha256(), hashlib.sha256(), (b"", b"")
                for at in range(0, len(parts), block):
                    found = [known.get(p) or chunk(p) for p in parts[at : at + block]]
                    n += sum(x[0] for x in found)
                    # The last blank is held back until more follows.
                    now = (held[0] + b"".join([x[1] for x in found]), held[1] + b"".join([x[2] for x in found]))
                    ids.update(now[0][:-1])
                    decoded.update(now[1][:-1])
                    held = (now[0][-1:], now[1][-1:])
                counts.append(n)
                ids_hex.append(ids.hexdigest())
                text_hex.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(text_hex)], schema.names)

    return kept.mapInArrow(run, schema)
