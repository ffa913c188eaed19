"""Quality rules: plain counts of a text, and how well a public vocabulary fits it.

Words are taken as they stand (white space parts them) and each is encoded by a public subword
vocabulary with byte fallback. Three measures follow for a text: characters per token, the share of
byte-fallback tokens, and the entropy of its tokens against the most that so many tokens allow. Each
has a fixed band for the text's script, and the characters per token one around the median of all texts
of its language (or script); a text outside a band is rejected. One pass over the texts without a shuffle,
in which distinct words are encoded once per task; the medians then come from the small measures.

Defined results: a null or wordless text has no words, fails the base rule and is not kept; equal texts
have equal results; unknown or null languages take the band of the script; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.arrow import append
from strata.llm.words import SPACED, Tokenizer, grams, mix
from strata.session import ensure_checkpoint_dir

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
KNOWN_WORDS = 400_000

#: By script: (least, most characters per token, most byte-fallback share, least relative entropy). Scripts
#: that the vocabulary spells out in bytes are allowed more of them.
BANDS = {
    "latin": (1.2, 8.0, 0.20, 0.40),
    "cyrillic": (1.0, 8.0, 0.20, 0.40),
    "greek": (0.8, 8.0, 0.40, 0.40),
    "hebrew_arabic": (0.7, 8.0, 0.40, 0.40),
    "cjk": (0.3, 4.0, 0.70, 0.35),
    "other": (0.3, 8.0, 0.80, 0.35),
}
#: Around the middle of the texts of a language: a text is outside if its characters per token differ by more
#: than this share and by more than so many standard errors. A standard error is the language's spread over the
#: root of the text's tokens; the spread is such that 68 % of its texts lie within one.
SHARE_BELOW, SHARE_ABOVE, ERRORS = 0.06, 0.50, 3.0
#: Languages with fewer texts take the middle of their script.
LEAST_TEXTS = 30
#: Bands of so many languages are broadcast (some 50 bytes each); more of them are joined by a shuffle.
BROADCAST_BANDS = 100_000
#: Lead bytes of UTF-8 by script; bytes of ASCII letters count as Latin.
SCRIPT_LEADS = {"latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF],
                "cyrillic": [*range(0xD0, 0xD5)], "hebrew_arabic": [0xD6, 0xD7, *range(0xD8, 0xDC)],
                "cjk": [*range(0xE3, 0xEE)], "other": [0xE0, 0xE1, 0xE2, 0xF0]}

LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens"]
FIELDS = [*[T.StructField(c, T.LongType()) for c in LONGS], T.StructField("token_entropy", T.DoubleType()),
          T.StructField("script", T.StringType())]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


def keyed(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes told apart by row."""
    return mix(hashes + mix(row.astype(np.uint64) + np.uint64(1)))


def repeated(h: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a window of ``size`` words that its row has more than once."""
    g = grams(h, size)
    at = np.flatnonzero(row[:len(g)] == row[size - 1:]) if len(g) else np.zeros(0, np.int64)
    _, which, n = np.unique(keyed(g[at], row[at]), return_inverse=True, return_counts=True)
    first = at[n[which] > 1]
    change = np.zeros(len(h) + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, first + size, -1)
    return np.cumsum(change)[:-1] > 0


def base_counts(data, offsets, tokenizer, lines, word_bytes, symbol_bytes):
    row, starts, ends, h, bounds = tokenizer.words(data, offsets)
    a, z = lines.spans(data, offsets)
    full = np.searchsorted(starts, a) < np.searchsorted(starts, z)
    a, z = a[full], z[full]
    line_row = np.searchsorted(offsets, a, "right") - 1
    _, first = np.unique(keyed(lines.hashes(data, a, z), line_row), return_index=True)
    n_rows = len(offsets) - 1
    counts = (np.diff(bounds), row_sums(word_bytes[data], offsets), row_sums(symbol_bytes[data], offsets),
              np.bincount(line_row, minlength=n_rows) - np.bincount(line_row[first], minlength=n_rows),
              row_sums(repeated(h, row, WINDOW), bounds))
    return (row, starts, ends, h, bounds), counts


class Vocabulary:
    """Token ids of words, remembered by word hash up to a fixed number of words."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])
        self.known: dict[int, list[int]] = {}

    def encode(self, data, starts, ends, hashes):
        """(ids of all words one after another, number of ids of each word)."""
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > KNOWN_WORDS:
            self.known = {}
        known, raw = self.known, data.tobytes()
        new = [(u, raw[starts[i]:ends[i]].decode()) for u, i in zip(unique.tolist(), first.tolist(), strict=True) if u not in known]
        if new:
            known.update(zip([u for u, _ in new], self.model.encode([w for _, w in new], num_threads=1), strict=True))
        lists = [known[u] for u in unique.tolist()]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(size.sum()))
        begin, n = (np.cumsum(size) - size)[which], size[which]
        return flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


def relative_entropy(ids: np.ndarray, row: np.ndarray, rows: int, vocabulary: int) -> np.ndarray:
    """Entropy of each row's ids, over the most that its number of ids allows (1 for fewer than two)."""
    key, n = np.unique(row * vocabulary + ids, return_counts=True)
    of = key // vocabulary
    total = np.bincount(row, minlength=rows)
    share = n / total[of]
    entropy = np.bincount(of, weights=-share * np.log2(share), minlength=rows)
    most = np.log2(np.clip(total, 2, vocabulary))
    return np.where(total > 1, entropy / most, 1.0)


def measure(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them if None) with the counts and measures of the text."""
    model = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def start():
        words = Vocabulary(model.value)
        tokenizer = Tokenizer(SPACED, lower=False)
        line = np.ones(256, bool)
        line[0x0A] = False
        lines = Tokenizer(line, lower=False)
        word_bytes = SPACED & ((np.arange(256) & 0xC0) != 0x80)
        symbol_bytes = np.isin(np.arange(256), list(SYMBOLS))
        scripts = list(SCRIPT_LEADS)
        lead = np.full(256, len(scripts), np.int64)
        for i, s in enumerate(scripts):
            lead[SCRIPT_LEADS[s]] = i

        def kernel(data, offsets, batch):
            rows = len(offsets) - 1
            (row, starts, ends, h, _), counts = base_counts(data, offsets, tokenizer, lines, word_bytes, symbol_bytes)
            ids, n = words.encode(data, starts, ends, h)
            of = np.repeat(row, n)
            n_tokens = np.bincount(of, minlength=rows)
            n_bytes = np.bincount(of[words.is_byte[ids]], minlength=rows)
            entropy = relative_entropy(ids, of, rows, len(words.is_byte))
            kind = lead[data]
            by_script = np.stack([row_sums(kind == i, offsets) for i in range(len(scripts))])
            script = [scripts[i] if n else "other" for i, n in zip(by_script.argmax(0), by_script.max(0), strict=True)]
            return [*counts, n_tokens, n_bytes, entropy, script]

        return kernel

    return append(docs, FIELDS, start, text, keep=keep, slice_bytes=2 << 20)


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def per_token():
    return F.col("word_chars") / F.greatest("n_tokens", F.lit(1))


def sized(bands: DataFrame) -> DataFrame:
    """Bands as a checkpoint, to be broadcast while there are few of them."""
    bands = bands.checkpoint()
    return F.broadcast(bands) if bands.count() <= BROADCAST_BANDS else bands


def middles(measured: DataFrame, lang: str | None) -> DataFrame:
    """Median and spread of the characters per token over all texts that pass the base rule, by language and by
    script (``of`` is "l:..." or "s:...")."""
    names = [F.concat(F.lit("s:"), "script")] + ([F.concat(F.lit("l:"), F.col(f"`{lang}`").cast("string"))] if lang else [])
    texts = (measured.where(~base_failed()).select(F.explode(F.array(*names)).alias("of"), per_token().alias("x"), "n_tokens")
             .where("of IS NOT NULL"))
    middle = (texts.groupBy("of").agg(F.percentile_approx("x", 0.5).alias("middle"), F.count("*").alias("n"))
              .where(F.col("n") >= LEAST_TEXTS).drop("n"))
    off = F.abs(F.col("x") - F.col("middle")) * F.sqrt("n_tokens")
    return texts.join(sized(middle), "of").groupBy("of", "middle").agg(F.percentile_approx(off, 0.68).alias("spread"))


def fits(band: str):
    """Whether all measures lie in the bands; ``band`` (middle, spread) is null where there are too few texts for one."""
    x, ok = per_token(), F.lit(False)
    for name, (least, most, byte_share, entropy) in BANDS.items():
        inside = (x >= least) & (x <= most) & (F.col("n_byte_tokens") <= byte_share * F.col("n_tokens"))
        ok = F.when(F.col("script") == name, inside & (F.col("token_entropy") >= entropy)).otherwise(ok)
    m, error = F.col(band)["middle"], ERRORS * F.col(band)["spread"] / F.sqrt(F.greatest("n_tokens", F.lit(1)))
    below = m - x > F.greatest(SHARE_BELOW * m, error)
    above = x - m > F.greatest(SHARE_ABOVE * m, error)
    return ok & ~F.coalesce(below | above, F.lit(False))


def verdicts(measured: DataFrame, lang: str | None = None) -> DataFrame:
    """``measured`` (read twice: give it checkpointed or written) with base_failed, band_middle, band_spread and kept."""
    ensure_checkpoint_dir(measured.sparkSession)
    known = sized(middles(measured, lang))
    out = measured.withColumn("base_failed", base_failed())
    for name, key in (("by_script", F.concat(F.lit("s:"), "script")),
                      ("by_lang", F.concat(F.lit("l:"), F.col(f"`{lang}`").cast("string")) if lang else F.lit(None).cast("string"))):
        side = known.select(F.col("of").alias(f"{name}_of"), F.struct("middle", "spread").alias(name))
        out = out.join(side, key == F.col(f"{name}_of"), "left").drop(f"{name}_of")
    out = out.withColumn("band", F.coalesce("by_lang", "by_script")).drop("by_lang", "by_script")
    kept = ~F.col("base_failed") & fits("band")
    return out.select("*", F.col("band.middle").alias("band_middle"), F.col("band.spread").alias("band_spread"), kept.alias("kept")).drop("band")
