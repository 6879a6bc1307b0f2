"""Quality rules from tokeniser fertility.

Public vocabularies measure each text: characters per token in a byte-level and in a piece vocabulary, the
share of byte-fallback tokens, the share of tokens of signs only, and the entropy of its tokens. A text is rejected where a measure leaves its
band; bands depend on the language column if it names a known language, else on the text's main script.
Words are tokenised once per block, as both vocabularies split at white space.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperslip.llm import pretokens as P
from paperslip.llm.text_arrays import coded, flat, gathered, pack, split_words

#: Bands: (low, high) of characters per piece token, characters per byte-level token, byte-fallback share,
#: token entropy in bits, and share of tokens without a letter or digit. Entropy has a low bound only from
#: MIN_TOKENS on, where it has settled. They lie outside of what running prose of a language has (about 3 to 4.5
#: characters per piece, 7 to 11 bits, a tenth of signs) by a factor of 1.5 to 2, so that they reject what is no
#: prose: strings of signs, digits or bytes below, repeated or run-together text above. A script without a band of
#: its own language gets the wide ones.
BANDS: dict[str, dict[str, tuple[float, float]]] = {
    "en": {"piece_chars": (1.7, 6.5), "byte_chars": (1.7, 7.0), "fallback": (0.0, 0.02), "entropy": (4.5, 15.0), "signs": (0.0, 0.16)},
    "de": {"piece_chars": (1.7, 6.5), "byte_chars": (1.6, 6.0), "fallback": (0.0, 0.02), "entropy": (4.5, 15.0), "signs": (0.0, 0.16)},
    "fr": {"piece_chars": (1.5, 6.5), "byte_chars": (1.5, 6.0), "fallback": (0.0, 0.02), "entropy": (4.5, 15.0), "signs": (0.0, 0.16)},
    "es": {"piece_chars": (1.5, 6.5), "byte_chars": (1.4, 6.0), "fallback": (0.0, 0.02), "entropy": (4.5, 15.0), "signs": (0.0, 0.16)},
    "latin": {"piece_chars": (1.3, 7.0), "byte_chars": (1.1, 7.5), "fallback": (0.0, 0.05), "entropy": (4.0, 15.0), "signs": (0.0, 0.2)},
    "other": {"piece_chars": (0.3, 7.0), "byte_chars": (0.25, 7.5), "fallback": (0.0, 0.75), "entropy": (3.5, 15.0), "signs": (0.0, 0.3)},
}
MIN_TOKENS = 100
#: Text bytes per block.
BLOCK = 3 << 19
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
MEASURES = ("piece_chars", "byte_chars", "fallback", "entropy", "signs")
RESULTS = ("lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *MEASURES, "script")


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def _fallback_ids(path: str) -> np.ndarray:
    model = _pieces(path)
    return np.array([model.is_byte(i) for i in range(model.get_piece_size())], bool)


@lru_cache(maxsize=2)
def _sign_ids(path: str) -> np.ndarray:
    """Pieces with no letter and no digit (byte tokens are not counted among them)."""
    model = _pieces(path)
    names = [model.id_to_piece(i).strip("\u2581") for i in range(model.get_piece_size())]
    return np.array([bool(x) and not any(c.isalnum() for c in x) for x in names], bool)


_memo: dict[str, dict[str, list[int]]] = {}


def _piece_lists(words: pa.Array, path: str) -> pa.ListArray:
    known, model = _memo.setdefault(path, {}), _pieces(path)
    if len(known) > P.MEMO:
        known.clear()
    texts = words.cast(pa.string()).to_pylist()
    new = [w for w in texts if w not in known]
    fresh = dict(zip(new, model.encode(new, num_threads=1), strict=True)) if new else {}
    ids = [fresh[w] if w in fresh else known[w] for w in texts]
    known.update((w, x) for w, x in fresh.items() if len(w) < 40)
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([i for x in ids for i in x], pa.uint32()))


def _repeated_words(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, the words in three-word windows that occur twice or more in it."""
    n = len(codes)
    out = np.zeros(len(first) - 1, np.int64)
    if n < 3:
        return out
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = text[: n - 2] == text[2:]
    # a window's number: first pairs of codes, then triples, then triples by text
    _, pair = np.unique(codes[:-1].astype(np.int64) << 32 | codes[1:], return_inverse=True)
    _, triple = np.unique(pair[:-1].astype(np.int64) << 32 | codes[2:], return_inverse=True)
    at = np.flatnonzero(whole)
    _, window, count = np.unique(text[at] << 32 | triple[at], return_inverse=True, return_counts=True)
    hit = at[count[window] > 1]
    marked = np.zeros(n, bool)
    for i in range(3):
        marked[hit + i] = True
    np.add.at(out, text[marked], 1)
    return out


def _repeated_lines(raw: bytes) -> int:
    if b"\n" not in raw:
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += bool(line.split(None, 1))
        else:
            seen.add(line)
    return n


def _entropy(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of the token distribution of each text."""
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    key, count = np.unique(text << 32 | ids.astype(np.int64), return_counts=True)
    owner = key >> 32
    total = np.diff(ends).astype(np.float64)
    share = count / total[owner]
    return np.bincount(owner, -share * np.log2(share), len(ends) - 1)


def measure(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """(key, lang, counts, fertility measures) of every row.

    Counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Measures: piece_chars, byte_chars
    (code points of words per token), fallback (share of byte tokens), entropy (bits), signs, n_tokens, and
    `script`, latin or other by the majority of letters. Null, empty and blank texts have no words and null
    measures. A missing language column counts as null languages. Null keys and repeated rows give a row
    each; other columns, of any name, are left out. The key may not be named like a result. A text of any
    length is measured in one task, at about 60 bytes of memory a byte.
    """
    if key in RESULTS:
        raise ValueError(f"{key} is the name of a result")
    piece_path, byte_path = vocabularies or default_vocabularies()

    def run(batches):
        for block in gathered(batches, "text", BLOCK):
            data, ends = flat(block["text"])
            raw = data.tobytes()
            starts, stops, first = split_words(data, ends)
            n_words = np.diff(first)
            codes, words = coded(pack(data, starts, stops))
            body, cuts = flat(words)
            heads = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))
            chars = np.diff(heads[cuts])[codes] if len(codes) else np.zeros(0, np.int64)
            word_chars = np.diff(np.concatenate(([0], np.cumsum(chars)))[first])
            symbols = np.diff(np.concatenate(([0], np.cumsum(_SYMBOL[data])))[ends])
            latin = np.concatenate(([0], np.cumsum((data < 0x80) & (data > 0x40) | (data >= 0xC3) & (data <= 0xC9))))
            wide = np.concatenate(([0], np.cumsum(data >= 0xCA)))
            dup = [_repeated_lines(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            pieces, piece_ends = P.rebuilt(_piece_lists(words, piece_path), codes, first)
            bytewise = P.encode_words(pc.binary_join_element_wise(pa.scalar(b" "), words, pa.scalar(b"")) if len(words) else words, byte_path, whole=False)
            byte_ends = np.concatenate(([0], np.cumsum(np.diff(bytewise.offsets.to_numpy())[codes] if len(codes) else np.zeros(0, np.int64))))[first]
            n_pieces, n_bytes = np.diff(piece_ends), np.diff(byte_ends)
            fallback = np.diff(np.concatenate(([0], np.cumsum(_fallback_ids(piece_path)[pieces])))[piece_ends])
            signs = np.diff(np.concatenate(([0], np.cumsum(_sign_ids(piece_path)[pieces])))[piece_ends])
            none = n_words == 0
            share = lambda a, b: pa.array(a / np.maximum(b, 1), mask=none)
            yield pa.RecordBatch.from_arrays(
                [
                    *(block[c].combine_chunks() if isinstance(block[c], pa.ChunkedArray) else block[c] for c in ("k", "lang")),
                    *(pa.array(np.asarray(x, np.int64)) for x in (n_words, word_chars, symbols, dup, _repeated_words(codes, first), n_pieces)),
                    share(word_chars, n_pieces),
                    share(word_chars, n_bytes),
                    share(fallback, n_pieces),
                    pa.array(_entropy(pieces, piece_ends), mask=none),
                    share(signs, n_pieces),
                    pa.array(np.where(np.diff(wide[ends]) > np.diff(latin[ends]), "other", "latin")),
                ],
                names=[key, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *MEASURES, "script"],
            )

    language = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("k"), language.alias("lang"), F.col(text).cast("string").alias("text"))
    fields = "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, piece_chars double, byte_chars double, fallback double, entropy double, signs double, script string"
    return rows.mapInArrow(run, T.StructType([T.StructField(key, docs.schema[key].dataType), *T.StructType.fromDDL(fields).fields]))


def judge(measured: DataFrame, bands: dict[str, dict[str, tuple[float, float]]] | None = None, *, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Adds base_failed, `rejected_by` (the measures outside their bands) and kept.

    base_failed: fewer than 50 words, or over half of them in repeated three-word windows. The band is that
    of the language if `bands` has it, else of the script.
    """
    bands = bands or BANDS
    band = F.when(F.col("lang").isin([b for b in bands if b not in ("latin", "other")]), F.col("lang")).otherwise(F.col("script"))

    def outside(measure: str):
        out = F.lit(False)
        for name, limits in bands.items():
            low, high = limits[measure]
            low_applies = F.col("n_tokens") >= min_tokens if measure == "entropy" else F.lit(True)
            out = F.when(F.col("_band") == name, (low_applies & (F.col(measure) < low)) | (F.col(measure) > high)).otherwise(out)
        return F.when(F.coalesce(out, F.lit(False)), F.lit(measure))

    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measured.withColumn("_band", band).withColumn("base_failed", base).withColumn("rejected_by", F.array_compact(F.array(*map(outside, MEASURES))))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_band")
