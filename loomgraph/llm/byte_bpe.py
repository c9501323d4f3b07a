"""Byte-level BPE through a sentencepiece model that is serialised directly from the vocabulary.

Each byte stands as one character (``chr(256 + byte)``) and each vocabulary entry as a piece of such characters, scored by its
negative rank, with identity normalisation. Pre-tokens are encoded one by one: one that is itself an entry is that entry, any
other is merged by sentencepiece, which joins the best-scored adjacent pair first, the leftmost of equals, as byte-level BPE does.
Decoding maps ids back to pieces and characters back to bytes.

Defined cases: a null text counts as empty and gives no ids; repeated rows each get their result; an empty table gives an empty
result; a text of one very long pre-token is encoded whole; further columns pass through unless they bear an output's name.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

#: Pre-tokens that a Python worker keeps the ids of; beyond, it starts anew.
CACHE_SIZE = 200_000
_TO_CHARS = {b: chr(256 + b) for b in range(256)}


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


def to_bytes(chars: str) -> bytes:
    return bytes(ord(c) - 256 for c in chars)


def read_ranks(path: str) -> list[bytes]:
    """Entries by rank of a file with a base64 entry and its rank in each line; ranks are 0, 1, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = sorted((int(r), base64.b64decode(e)) for e, r in pairs)
    if [r for r, _ in ranks] != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, ... without a gap")
    return [e for _, e in ranks]


def serialise(entries: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece 0 is unknown, entry of rank r is piece r + 1 with the score -r."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for r, e in enumerate(entries):
        m.pieces.add(piece=to_chars(e), score=float(-r), type=pb.ModelProto.SentencePiece.NORMAL)
    t, n = m.trainer_spec, m.normalizer_spec
    t.model_type, t.vocab_size = pb.TrainerSpec.BPE, len(entries) + 1
    t.unk_id, t.bos_id, t.eos_id, t.pad_id = 0, -1, -1, -1
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return m.SerializeToString()


class ByteBpe:
    """Encoder and decoder of one vocabulary, with a bounded memory of pre-tokens."""

    def __init__(self, entries: list[bytes], pattern: str) -> None:
        import regex
        import sentencepiece

        self.entries, self.rank = entries, {e: r for r, e in enumerate(entries)}
        self.split = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialise(entries))
        self.inverse = [b"", *(to_bytes(self.pieces.id_to_piece(r + 1)) for r in range(len(entries)))]
        self.known: dict[str, bytes] = {}

    def _learn(self, tokens: set[str]) -> None:
        merged: list[str] = []
        for t in tokens:
            r = self.rank.get(t.encode("utf-8", "surrogatepass"))
            if r is None:
                merged.append(t)
            else:
                self.known[t] = r.to_bytes(4, "little")
        chars = [to_chars(t.encode("utf-8", "surrogatepass")) for t in merged]
        for t, ids in zip(merged, self.pieces.encode(chars, out_type=int, num_threads=1) if chars else [], strict=True):
            self.known[t] = b"".join((i - 1).to_bytes(4, "little") for i in ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        tokens = self.split(text) if text else []
        if missing := set(tokens).difference(self.known):
            if len(self.known) > CACHE_SIZE:
                self.known.clear()
                missing = set(tokens)
            self._learn(missing)
        return b"".join(map(self.known.__getitem__, tokens))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.inverse[i + 1] for i in ids])


_BUILT: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker and vocabulary."""
    if (path, pattern) not in _BUILT:
        _BUILT[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _BUILT[path, pattern]


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds ids, an array of token ids. path must be readable on every executor."""

    def make():
        import numpy as np

        t = tokenizer(path or vocabulary_path(), pattern or pre_token_pattern())
        return lambda texts: ([np.frombuffer(t.encode(x), "<u4").astype("i4") for x in texts],)

    return map_texts(docs, make, [("ids", "array<int>")], text, keep_text)


def decode_ids(encoded: DataFrame, path: str | None = None, pattern: str | None = None, ids: str = "ids") -> DataFrame:
    """Puts data, the bytes that the ids stand for, in the place of ids; null ids count as none."""

    def make():
        t = tokenizer(path or vocabulary_path(), pattern or pre_token_pattern())
        return lambda rows: ([t.decode(x or []) for x in rows],)

    return map_texts(encoded, make, [("data", "binary")], ids)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 of each text encoded and decoded again; with_ids adds the ids too."""

    def make():
        import numpy as np

        t = tokenizer(path or vocabulary_path(), pattern or pre_token_pattern())

        def run(texts):
            sizes, sums, decoded, kept = [], [], [], []
            for x in texts:
                data = t.encode(x)
                ids = np.frombuffer(data, "<u4")
                sizes.append(len(ids))
                sums.append(hashlib.sha256(data).hexdigest())
                decoded.append(hashlib.sha256(t.decode(ids.tolist())).hexdigest())
                if with_ids:
                    kept.append(ids.astype("i4"))
            return [sizes, sums, decoded, *([kept] * with_ids)]

        return run

    new = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *([("ids", "array<int>")] * with_ids)]
    return map_texts(docs, make, new, text)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every whole text of documents."""
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
