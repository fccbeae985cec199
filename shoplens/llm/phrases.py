"""Frequent phrases and their collocation scores, found by Rabin-Karp fingerprints.

Tasks split texts into pieces at punctuation and line ends and pieces into words by whole-array arithmetic on their UTF-8
bytes (numpy; all separators are ASCII). A word's code is a polynomial over its bytes, and its 64-bit hash is Spark's hash of
the code. This is cheap enough to be done again in every pass, so nothing of a text's size is stored. Polynomial prefix sums over a document's
word hashes (numpy, wrapping uint64) give the fingerprint of every n-gram in constant time; the language's hash is
mixed in, so a fingerprint stands for a language and a phrase. Levels run from 1 to 5 words; at level m only n-grams
whose two (m-1)-word parts were frequent are fingerprinted, which loses nothing since a phrase is never more frequent
than its parts. Each task pre-aggregates its fingerprints; a shuffle of two numbers a row sums them. One more pass over
the texts takes, for the frequent fingerprints only, the first occurrence (row, word) and the range of a check value: a
second polynomial with another base over independent word codes. A first look at a thirty-second of the rows tells
place and check value of nearly all of them to the pass over all rows, whose tasks then report only what is missing or
differs. Where the check values of one fingerprint differ, two
texts collided: that fingerprint is counted again keyed by language and text (a collision only ever raises a count, so
nothing frequent was lost before). Only frequent phrases are spelled, from their pointer into the text, and they are
scored and ranked with Spark expressions in exact decimal arithmetic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.shared import checkpointed, shuffle_partitions

#: Piece ends and word separators of the contract.
PIECE_END = "[.,;:!?\\x0A-\\x0D]"
WORD = "[^\\x20\\x09]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bases of the two polynomial fingerprints.
BASES = (0x100000001B3, 0x9E3779B97F4A7C15)
#: Longest phrase, least occurrences of a candidate, rows of each language's report.
LONGEST, AT_LEAST, TOP = 5, 100, 2000
#: Frequent fingerprints of a level that are sent to every task for pruning; beyond, the next level is
#: counted without pruning (same result, more rows).
PRUNE_BOUND = 4_000_000
#: Of so many rows one, chosen by hash, is looked at first for places and check values; all rows follow.
FIRST_LOOK = 32
#: Frequent phrases whose places in the texts are broadcast; beyond, texts are shuffled to them.
SPELL_BOUND = 500_000
UNDETERMINED = "und"

_PIECE_RE, _WORD_RE = re.compile(PIECE_END), re.compile(WORD)
_LOWER = str.maketrans(UPPER, LOWER)


def words_of(text: str | None) -> tuple[list[str], list[int]]:
    """Words of a text (A-Z lower-cased, null empty) and the piece each stands in."""
    words, pieces = [], []
    for k, piece in enumerate(_PIECE_RE.split((text or "").translate(_LOWER))):
        found = _WORD_RE.findall(piece)
        words += found
        pieces += [k] * len(found)
    return words, pieces


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _first_hash(word: Column) -> Column:
    """64-bit hash of a word (of its code) for the fingerprint."""
    return F.xxhash64(word)


def _tongue(lang: Column) -> Column:
    """64-bit hash of a language, of an input that no word has (a word `de` in `es` is not a word `es` in `de`)."""
    return F.xxhash64(F.concat(F.lit("\x02\x20"), lang))


def tokens(rows: DataFrame, check: bool = False, spell: bool = False, code: bool = True) -> DataFrame:
    """Per row: lang ('und' for null), its hash, _row, word hash h1 and the number of words of each piece with a word.

    With check also independent word hashes h2, with spell the words, without code no h1.
    """
    lang = F.coalesce(F.col("lang"), F.lit(UNDETERMINED))
    texts = rows.select(lang.alias("lang"), _tongue(lang).alias("tongue"), "_row", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = ("lang string, tongue long, _row long, sizes array<int>" + ", code array<long>" * code + ", h2 array<long>" * check
              + ", words array<string>" * spell)
    coded = texts.mapInArrow(_coded(check, spell, code), schema)
    return coded.select("lang", "tongue", "_row", *[F.transform("code", _first_hash).alias("h1")] * code, "sizes",
                        *["h2"] * check, *["words"] * spell)


#: Words per share of a batch that is fingerprinted at once (bounds a task's arrays to some 100 MB).
CHUNK_WORDS = 1 << 20


def _powers(base: int, count: int) -> np.ndarray:
    """base**i mod 2**64 for i < count."""
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


_POWERS: dict = {}


def _powers_upto(base: int, count: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < count:
        have = _POWERS[base] = _powers(base, max(count, CHUNK_WORDS + 16, 2 * len(have) if have is not None else 0))
    return have[:count]


def _prints(hashed: np.ndarray, base: int, m: int) -> np.ndarray:
    """Polynomial fingerprint of every run of m consecutive hashes.

    With S[k] = sum of w_j * base**-j for j < k (base odd, so invertible mod 2**64), the fingerprint
    sum of w_{i+t} * base**(m-1-t) is base**(i+m-1) * (S[i+m] - S[i]): prefix sums, all in wrapping uint64.
    """
    count = len(hashed) - m + 1
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(hashed) + 1, np.uint64)
        np.cumsum(hashed * _powers_upto(pow(base, -1, 1 << 64), len(hashed)), out=prefix[1:])
        return _powers_upto(base, len(hashed))[m - 1:] * (prefix[m:] - prefix[:count])


def _mixed(a: np.ndarray) -> np.ndarray:
    """The numbers with their bits spread (the finalizer of splitmix64, one to one)."""
    with np.errstate(over="ignore"):
        a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return a ^ (a >> np.uint64(31))


#: By byte: lower case of A-Z; 0 in a word, 1 between words, 2 between pieces; its numbers in the two word polynomials.
_LOWER_BYTE = np.arange(256, dtype=np.uint8)
_LOWER_BYTE[65:91] += 32
_PART = np.zeros(256, np.uint8)
_PART[[0x20, 0x09]] = 1
_PART[list(b".,;:!?\n\x0b\x0c\r")] = 2
_BYTE_NUMBERS = _mixed(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, 256)[:, _LOWER_BYTE]
#: Bases of the word polynomials; bytes of a share of a batch that is split at once; longest word that a polynomial tells
#: apart well (beyond, powers of two in differences add up, and words are digested one by one).
_BYTE_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
CHUNK_BYTES, LONG_WORD = 1 << 20, 64


def _word_codes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """One code per word data[begin:end]: prefix sums of byte numbers times powers, as in _prints; long words by digest."""
    base = _BYTE_BASES[which]
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_NUMBERS[which][data] * _powers_upto(pow(base, -1, 1 << 64), len(data)), out=prefix[1:])
        codes = _mixed(_powers_upto(base, len(data) + 1)[end] * (prefix[end] - prefix[begin]))
    for i in np.nonzero(end - begin > LONG_WORD)[0].tolist():
        digest = blake2b(_LOWER_BYTE[data[begin[i]:end[i]]].tobytes(), digest_size=16).digest()
        codes[i] = int.from_bytes(digest[8 * which:8 * which + 8], "little")
    return codes


def _split_texts(share: pa.RecordBatch, check: bool, spell: bool, code: bool = True) -> pa.RecordBatch:
    """tokens() of a share of texts, with codes in place of the first hash: whole-array arithmetic on bytes."""
    texts = share.column("text").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held if held is not None else b"", np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    part = _PART[data]
    # bytes 0..len: inside a word there, and inside one that goes on from the byte before
    inside = np.concatenate([part == 0, [False]])
    going_on = np.concatenate([[False], inside[:-1]])
    at_border = going_on[bounds]
    going_on[bounds] = False
    begin = np.nonzero(inside & ~going_on)[0]
    going_on[bounds] = at_border
    stops = going_on & ~inside
    stops[bounds] |= at_border
    end = np.nonzero(stops)[0]
    words_to = np.searchsorted(begin, bounds)
    piece = np.cumsum(part == 2, dtype=np.int32)[begin] if len(begin) else np.zeros(0, np.int32)
    opens = np.ones(len(begin), bool)
    opens[1:] = piece[1:] != piece[:-1]
    opens[words_to[words_to < len(begin)]] = True
    first = np.nonzero(opens)[0]
    sizes = np.diff(first, append=len(begin)).astype(np.int32)

    def lists(to, values):
        return pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(values))

    found = {k: share.column(k) for k in ("lang", "tongue", "_row")}
    found["sizes"] = lists(np.searchsorted(first, words_to), sizes)
    if code:
        found["code"] = lists(words_to, _signed(_word_codes(data, begin, end, 0)))
    if check:
        found["h2"] = lists(words_to, _signed(_word_codes(data, begin, end, 1)))
    if spell:
        low = _LOWER_BYTE[data].tobytes()
        words = [low[b:e].decode("utf-8", "replace") for b, e in zip(begin.tolist(), end.tolist())]
        found["words"] = lists(words_to, pa.array(words, pa.string()))
    return pa.RecordBatch.from_arrays(list(found.values()), names=list(found))


def _coded(check: bool, spell: bool, code: bool = True):
    """Per batch of texts their words, share by share (a longer text is a share of its own)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            for share in _cut(batch, lengths, CHUNK_BYTES):
                yield _split_texts(share, check, spell, code)
    return run


def _share_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a share of a batch, per word: hash, document (place in the batch), piece (over all documents); and each
    document's first word."""
    offsets = batch.column("h1").offsets.to_numpy()
    doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    sizes = batch.column("sizes").flatten().to_numpy(zero_copy_only=False)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    w1 = batch.column("h1").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return w1, doc, piece, offsets[:-1] - offsets[0]


def _tongue_prints(w: np.ndarray, base: int, m: int, tongue: np.ndarray) -> np.ndarray:
    """Fingerprints of the m-grams with their language's hash mixed in (tongue: per word)."""
    return _signed(_prints(w, base, m) ^ tongue[:len(w) - m + 1])


def _held(ordered: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the ordered array, and its place there (0 if it is not)."""
    if not len(ordered):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values, at


def _chunk(batch: pa.RecordBatch, m: int, parts: np.ndarray | None) -> pa.RecordBatch | None:
    """Pre-aggregated fingerprints of the m-grams of a share of a batch: whole-array arithmetic, no loop per word."""
    w1, doc, piece, _ = _share_words(batch)
    if len(w1) < m:
        return None
    tongue = batch.column("tongue").to_numpy(zero_copy_only=False).view(np.uint64)[doc]
    count = len(w1) - m + 1
    inside = piece[:count] == piece[m - 1:]
    if parts is not None:
        known = (piece[:count + 1] == piece[m - 2:]) & _held(parts, _tongue_prints(w1, BASES[0], m - 1, tongue))[0]
        inside &= known[:-1] & known[1:]
    fp = _tongue_prints(w1, BASES[0], m, tongue)[inside]
    if not len(fp):
        return None
    fp, n = np.unique(fp, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(fp), pa.array(n.astype(np.int64))], names=["fp", "n"])


def _respelled(batch: pa.RecordBatch, m: int, split: set) -> pa.RecordBatch | None:
    """Counts by language and text of the m-grams whose fingerprints are in split."""
    w1, doc, piece, _ = _share_words(batch)
    if len(w1) < m:
        return None
    tongue = batch.column("tongue").to_numpy(zero_copy_only=False).view(np.uint64)[doc]
    fp = _tongue_prints(w1, BASES[0], m, tongue)
    at = np.nonzero((piece[:len(fp)] == piece[m - 1:]) & np.isin(fp, np.array(sorted(split), np.int64)))[0]
    if not len(at):
        return None
    words = batch.column("words").flatten().to_pylist()
    langs = batch.column("lang").to_numpy(zero_copy_only=False)[doc[at]]
    table = pa.table({"lang": pa.array(langs, pa.string()),
                      "phrase": pa.array([" ".join(words[i:i + m]) for i in at.tolist()], pa.string())})
    grouped = table.group_by(["lang", "phrase"], use_threads=False).aggregate([([], "count_all")])
    return pa.RecordBatch.from_arrays([grouped[k].combine_chunks() for k in ("lang", "phrase", "count_all")],
                                      names=["lang", "phrase", "n"])


def _first_places(batch: pa.RecordBatch, wanted: dict[int, np.ndarray | None],
                  known: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
    """(m, fp, row, start, range of check values) of each wanted fingerprint at its first occurrence in a share.

    known: by m the ordered fingerprints that have a place already, and their check values; their occurrences with
    that check value are passed over.
    """
    w1, doc, piece, first = _share_words(batch)
    w2 = batch.column("h2").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    tongue = batch.column("tongue").to_numpy(zero_copy_only=False).view(np.uint64)[doc]
    rows_of = batch.column("_row").to_numpy(zero_copy_only=False).astype(np.int64)
    tables = []
    for m, keep in wanted.items():
        if len(w1) < m:
            continue
        fp = _tongue_prints(w1, BASES[0], m, tongue)
        inside = piece[:len(fp)] == piece[m - 1:]
        if keep is not None:
            inside &= _held(keep, fp)[0]
        at = np.nonzero(inside)[0]
        # the language belongs to the check value: two languages under one fingerprint are a collision as well
        check = _signed(_prints(w2, BASES[1], m)[at] ^ (tongue[at] * np.uint64(BASES[1])))
        if m in known:
            prints, checks = known[m]
            placed, where = _held(prints, fp[at])
            if placed.any():
                news = ~(placed & (checks[where] == check))
                at, check = at[news], check[news]
        if not len(at):
            continue
        order = np.argsort(fp[at], kind="stable")
        own = fp[at][order]
        begin = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]))[0]
        here = at[order][begin]
        tables.append(pa.table({
            "m": np.full(len(here), m, np.int32), "fp": own[begin],
            "row": rows_of[doc[here]], "start": (here - first[doc[here]]).astype(np.int64),
            "check_lo": np.minimum.reduceat(check[order], begin), "check_hi": np.maximum.reduceat(check[order], begin)}))
    if not tables:
        return None
    return pa.concat_tables(tables).combine_chunks().to_batches()[0]


def _cut(batch: pa.RecordBatch, lengths: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The batch cut into shares of about `most` in length (a longer row is a share of its own)."""
    sizes = np.cumsum(lengths, dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        done = int(sizes[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _shares(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return _cut(batch, np.diff(batch.column("h1").offsets.to_numpy()), CHUNK_WORDS)


def _by_share(take, *args):
    """Per batch of tokens(): what `take` finds, share by share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for share in _shares(batch):
                found = take(share, *args)
                if found is not None and found.num_rows:
                    yield found
    return run


PLACE_SCHEMA = "m int, fp long, row long, start long, check_lo long, check_hi long"


def _places(rows: DataFrame, wanted: dict, known: dict) -> DataFrame:
    return tokens(rows, check=True).mapInArrow(_by_share(_first_places, wanted, known), PLACE_SCHEMA)


def _one_place(places: DataFrame) -> DataFrame:
    """Per level and fingerprint an occurrence (whichever comes first) and the range of its check values."""
    return places.groupBy("m", "fp").agg(
        F.first(F.struct("row", "start")).alias("_at"), F.min("check_lo").alias("check_lo"), F.max("check_hi").alias("check_hi")
    ).select("m", "fp", "_at.row", "_at.start", "check_lo", "check_hi")


def _placed(rows: DataFrame, wanted: dict[int, np.ndarray | None]) -> DataFrame:
    """One place and the range of check values of every wanted fingerprint, over all rows.

    Without the first look every task would send every wanted fingerprint that it holds. Rows looked at first are read
    again with all others, so each occurrence is compared. A level without a set (beyond PRUNE_BOUND) has no first look.
    """
    sets = {m: keep for m, keep in wanted.items() if keep is not None}
    looked = checkpointed(_one_place(_places(rows.where(F.pmod(F.xxhash64("_row"), F.lit(FIRST_LOOK)) == 0), sets, {})))
    told = looked.select("m", "fp", "check_lo").orderBy("m", "fp").toArrow()
    level, prints, checks = (told[k].to_numpy() for k in ("m", "fp", "check_lo"))
    known = {m: (prints[level == m], checks[level == m]) for m in sets}
    return _one_place(looked.unionByName(_places(rows, wanted, known)))


def _counted(docs: DataFrame, m: int, parts: np.ndarray | None) -> DataFrame:
    """Sums per fingerprint (which holds the language): the shuffle moves two numbers a row."""
    return docs.mapInArrow(_by_share(_chunk, m, parts), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))


#: Documents per Arrow batch of the fingerprint passes: with up to 20,000 words of 20 bytes each, some 100 MB.
BATCH_ROWS = 256


@contextmanager
def _batches_of(spark, rows: int):
    """Arrow batches of at most `rows` rows for the jobs run inside; the setting is restored afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, at_least: int = AT_LEAST) -> tuple[DataFrame, DataFrame]:
    """(phrases: lang, m, phrase, f for every phrase of 1..longest words with f >= at_least; totals: lang, n).

    docs: lang, text (other columns are not read). Null lang counts as 'und', null text as empty. Repeated
    rows count as often as they stand.
    """
    with _batches_of(docs.sparkSession, BATCH_ROWS):
        return _frequent_phrases(docs, longest, at_least)


def _frequent_phrases(docs: DataFrame, longest: int, at_least: int) -> tuple[DataFrame, DataFrame]:
    # row ids of a deterministic input (a table) are the same each time it is read; texts are not copied
    rows = docs.select("lang", "text").withColumn("_row", F.monotonically_increasing_id())
    hashed = tokens(rows).drop("_row")
    totals = checkpointed(tokens(rows, code=False).groupBy("lang").agg(
        F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, size: n + size)).alias("n")))
    found, parts, wanted = None, None, {}
    for m in range(1, longest + 1):
        kept = checkpointed(_counted(hashed, m, parts).where(F.col("n") >= at_least))
        size = kept.count()
        parts = np.sort(kept.select("fp").toArrow()["fp"].to_numpy()) if size <= PRUNE_BOUND else None
        wanted[m] = parts
        kept = kept.withColumn("m", F.lit(m))
        found = kept if found is None else found.unionByName(kept)
    # an occurrence (whichever comes first, all spell the same) and check values of the frequent fingerprints only, all
    # levels together; a level whose set is beyond PRUNE_BOUND sends every n-gram's place, and the join keeps the frequent ones
    places = _placed(rows, wanted).withColumnsRenamed({"row": "_row", "start": "_start"})
    found = checkpointed(found.join(places, ["m", "fp"]))
    clashing = found.where(F.col("check_lo") != F.col("check_hi")).select("m", "fp")
    if clashing.count() > PRUNE_BOUND:
        raise ValueError("fingerprints collide too often: the word hash is broken")
    split: dict[int, set] = {}
    for r in clashing.collect():
        split.setdefault(r["m"], set()).add(r["fp"])
    out = _spelled(rows, found.where(F.col("check_lo") == F.col("check_hi")))
    for m, prints in sorted(split.items()):  # a fingerprint stands for several texts: those are counted by text
        recount = (tokens(rows, spell=True).mapInArrow(_by_share(_respelled, m, prints), "lang string, phrase string, n long")
                   .groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= at_least))
        out = out.unionByName(checkpointed(recount.select("lang", F.lit(m).alias("m"), "phrase", "f")))
    return out, totals


def _spelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Frequent fingerprints with their text, read at their first occurrence: only texts that hold one are split again."""
    places = found.groupBy("_row").agg(F.collect_list(F.struct("m", "_start", "n")).alias("_places"))
    texts = rows.join(F.broadcast(places) if found.count() <= SPELL_BOUND else places, "_row")
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    words = F.flatten(F.transform(F.split(lowered, PIECE_END, -1), lambda p: F.regexp_extract_all(p, F.lit(WORD), 0)))
    # words as the argument of a function: as a column, Spark would move their expression into the function over the places
    # and split the text again for each
    spelled = F.transform(F.array(words), lambda own: F.transform("_places", lambda p: F.struct(
        p["m"].alias("m"), F.array_join(F.slice(own, (p["_start"] + 1).cast("int"), p["m"]), " ").alias("phrase"),
        p["n"].alias("f"))))
    return texts.select(F.coalesce(F.col("lang"), F.lit(UNDETERMINED)).alias("lang"), F.inline(F.flatten(spelled)))


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def collocations(docs: DataFrame, longest: int = LONGEST, at_least: int = AT_LEAST, top: int = TOP) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    Candidates have 2..longest words and a >= at_least occurrences. A cut after k words scores
    floor(1000*a*n/(l*r)) in exact decimals; the lowest cut counts, ties to the smallest k. Candidates that
    stand contiguously inside a longer candidate with at least as many occurrences are dropped. Order: score
    descending, a descending, phrase ascending (UTF-8 bytes). An empty table gives no rows.
    """
    phrases, totals = frequent_phrases(docs, longest, at_least)
    phrases = checkpointed(phrases)
    cand = phrases.where(F.col("m") >= 2).withColumn("_w", F.split("phrase", " ", -1))
    cuts = cand.select("lang", "phrase", "m", "f", "_w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "f", "k", F.array_join(F.slice("_w", 1, F.col("k")), " ").alias("left"),
                       F.array_join(F.slice("_w", F.col("k") + 1, F.col("m")), " ").alias("right"))
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("pf"))
    cuts = (cuts.join(parts.withColumnRenamed("part", "left").withColumnRenamed("pf", "l"), ["lang", "left"])
            .join(parts.withColumnRenamed("part", "right").withColumnRenamed("pf", "r"), ["lang", "right"])
            .join(F.broadcast(totals), "lang"))
    score = F.expr("(cast(f as decimal(38,0)) * cast(n as decimal(38,0)) * 1000) div "
                   "(cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "f", "n")).alias("_b")).select("lang", "phrase", "_b.*")
    # sub-phrases of 2..m-1 words of every candidate, with the candidate's count
    subs = cand.select("lang", "f", "_w", "m", F.explode(F.sequence(F.lit(2), F.greatest(F.col("m") - 1, F.lit(2)))).alias("len"))
    subs = subs.where(F.col("len") < F.col("m")).select(
        "lang", "f", "_w", "len", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("len") + 1)).alias("at"))
    subs = subs.select("lang", F.array_join(F.slice("_w", F.col("at"), F.col("len")), " ").alias("phrase"),
                       F.col("f").alias("outer"))
    covered = subs.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = (best.join(covered, ["lang", "phrase"], "left")
            .where(F.col("outer").isNull() | (F.col("outer") < F.col("f"))).drop("outer"))
    order = [F.col("score").desc(), F.col("f").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession)))
    local = Window.partitionBy("lang", "_salt").orderBy(*order)
    shortlist = (kept.withColumn("_salt", salt).withColumn("_local", F.row_number().over(local))
                 .where(F.col("_local") <= top).drop("_salt", "_local"))
    ranked = shortlist.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long"), "phrase", F.col("f").alias("a"), F.col("l").cast("long"),
        F.col("r").cast("long"), F.col("n").cast("long"), F.col("score").cast("long"), "k")
