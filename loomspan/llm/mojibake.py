"""Texts decoded with the wrong character encoding (problem 8).

Words that hold other than ASCII characters are the units, each with what remains of its neighbours without them. A
garbled word has a near-twin when the same place (stripped neighbours and stripped word, digits generalised) also holds
the word in clean form. Twins are found by an equi-join on the stripped text and the repaired word; aligning the
characters of twins shows which transformations (encoded as A, decoded as B) the corpus suffers from, and the learned
ones are applied to all remaining words.

A learned transformation of several bytes (UTF-8, Shift-JIS, EUC-JP read as single bytes) marks a word by its bytes where
these tell (all its other characters decode); any learned transformation marks a word whose repaired form is the commoner
one in the same place and in the corpus, or a clearly commoner word of at least three characters. Common is what stands in
many different texts: copies of one text count once, and only where as many texts hold both forms do their rows decide. A
learned transformation of single bytes also marks a word whose repaired form reads better, whether or not that very word
is found: all of it in one other script, or its changed letters common between their neighbours where the garbled ones are
rare. U+FFFD marks a text by itself: what stood there is lost.

Defined results: null, empty and ASCII texts are no cases; escapes spelled out in ASCII are ASCII; a text in which some
characters are lost is restored as far as possible (complete = false); repeated rows of a doc_id count once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.tokens import spread
from loomspan.session import cut, table

#: Encodings that a text may have been written and read in (fixed values: Python's codec names).
MULTI = ("utf-8", "shift_jis", "euc_jp", "gbk")
SINGLE_TRUE = ("cp1252", "cp1250", "cp1251", "cp1253", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_7", "cp866", "cp437", "cp850", "mac_roman")
READ_AS = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_2", "iso8859_15", "koi8_r", "cp866", "cp1253", "iso8859_7", "cp1254")
LETTERS = ("cp1251", "koi8_r", "cp866", "cp1253", "iso8859_7")  # whose upper half is mostly letters of one script
LOST = "\ufffd"
SUPPORT = 2  # places with twins that a single-byte transformation needs
SELF_SUPPORT = 2  # different telling words that a transformation of several bytes needs where no twin is at hand
NEAR_TEXTS, NEAR_RATIO = 8, 8  # texts that hold a repaired letter between its neighbours, and times those of the garbled one
WHITE = r"[ \t\r\n\f\x0B]+"
UNSPACED = "\u3000-\u9fff\uac00-\ud7af\uff00-\uffef"  # scripts written without spaces: a run of them is a word of its own


@lru_cache(None)
def _bytes_of(codec: str) -> dict[str, int]:
    """Byte of each character above ASCII in a single-byte encoding; bytes it leaves open stand for themselves, as most
    decoders let them pass."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


def many_bytes(how: str) -> bool:
    return how.split(">")[0] in MULTI


def _bytes(word: str, read_as: str) -> bytes | None:
    table_ = _bytes_of(read_as)
    raw = bytearray()
    for c in word:
        if c < "\x80":
            raw.append(ord(c))
        elif c in table_:
            raw.append(table_[c])
        else:
            return None
    return bytes(raw)


def _decoded(word: str, raw: bytes, true: str) -> str | None:
    try:
        r = raw.decode(true)
    except UnicodeDecodeError:
        return None
    if r == word or LOST in r:
        return None
    if true in ("utf-8", *SINGLE_TRUE) and sum(c < "\x80" for c in r) != sum(c < "\x80" for c in word):
        return None
    # what was garbled twice still has control characters after one step
    wrong = ("Cn", "Co", "Cs") if true == "utf-8" else ("Cc", "Cn", "Co", "Cs")
    return None if any(unicodedata.category(c) in wrong for c in r if c >= "\x80") else r


def repair(word: str, true: str, read_as: str) -> str | None:
    """The word as it was before it was written in ``true`` and read in ``read_as``; None if it can't have been."""
    raw = _bytes(word, read_as)
    return None if raw is None else _decoded(word, raw, true)


def repairs(word: str) -> list[tuple[str, str]]:
    """(transformation, repaired word) of every hypothesis that the word allows."""
    out = []
    for read_as in READ_AS:
        raw = _bytes(word, read_as)
        if raw is not None:
            out += [(f"{true}>{read_as}", r) for true in MULTI + SINGLE_TRUE if true != read_as and (r := _decoded(word, raw, true)) is not None]
    return out


#: Blocks of characters that running text is made of (fixed values: first and last code point).
USUAL = ((0x80, 0x24F), (0x300, 0x52F), (0x1E00, 0x27BF), (0x27E6, 0x27EF), (0x2900, 0x2BFF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF00, 0xFFEF), (0x1F000, 0x1FAFF))


def telling(how: str, repaired: str) -> bool:
    """Whether the bytes alone tell that a word is garbled: UTF-8 sequences of usual characters, Latin ones (or several of
    an unspaced script) beside Latin letters, or Japanese text all through."""
    true, read_as = how.split(">")
    other = [c for c in repaired if c >= "\x80"]
    if true == "utf-8":
        if read_as in LETTERS or not all(any(a <= ord(c) <= z for a, z in USUAL) for c in other):
            return False
        unspaced = [c for c in other if "\u3000" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7af" or "\uff00" <= c <= "\uffef"]
        if len(unspaced) == 1:  # three characters may make one by chance (an accent, a quote and an ellipsis)
            return False
        beside = {x for pair in zip(repaired, repaired[1:]) for x, y in (pair, pair[::-1]) if x >= "\x80" and y.isascii() and y.isalpha() and x.isalpha()}
        return all(unicodedata.name(c, "").startswith(("LATIN", "FEMININE", "MASCULINE", "MICRO", "MODIFIER")) for c in beside.difference(unspaced))
    kana = sum("\u3040" <= c <= "\u30ff" for c in other)
    return true in ("shift_jis", "euc_jp") and kana >= 3 and all("\u3000" <= c <= "\u9fff" or "\uff00" <= c <= "\uffef" for c in other)


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Runs of other than ASCII characters that stand between the same ASCII characters."""

    def runs(w: str) -> list[str]:
        out, run = [], ""
        for c in w:
            if c < "\x80":
                out.append(run)
                run = ""
            else:
                run += c
        return [*out, run]

    a, b = runs(garbled), runs(clean)
    return [(x, y) for x, y in zip(a, b) if x and y and x != y] if len(a) == len(b) else []


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^\x00-\x7F]+", ""), "[0-9]", "0")


def words_of(documents: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), place, word: every word with other than ASCII characters (digits generalised); the place is a hash of the
    stripped words before and after it."""
    arr = documents.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", F.xxhash64("text").alias("key"), F.split(F.regexp_replace("text", f"[{UNSPACED}]+", " $0 "), WHITE).alias("ws"))
    near = F.filter(F.transform("ws", lambda w, i: F.struct(F.get("ws", i - 1).alias("p"), w.alias("w"), F.get("ws", i + 1).alias("n"))), lambda x: x["w"].rlike(r"[^\x00-\x7F]"))
    x = arr.select("doc_id", "key", F.explode(near).alias("x"))
    place = F.xxhash64(stripped(F.coalesce("x.p", F.lit(""))), stripped(F.coalesce("x.n", F.lit(""))))
    return x.select("doc_id", "key", place.alias("place"), F.regexp_replace("x.w", "[0-9]", "0").alias("word"))


REPAIRS = "place bigint, word string, n bigint, n_rows bigint, how string, repaired string, multi boolean, telling boolean"


def possible_repairs(places: DataFrame) -> DataFrame:
    """place, word, n, n_rows -> a row for each hypothesis the word allows: how, repaired, multi, telling."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[tuple]] = {}
        for b in batches:
            if len(known) > 200_000:
                known.clear()
            out = []
            for place, word, n, n_rows in b.itertuples(index=False):
                if word not in known:
                    known[word] = [(how, r, many_bytes(how), telling(how, r)) for how, r in repairs(word)]
                out += [(place, word, n, n_rows, *x) for x in known[word]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REPAIRS.split(", ")])

    return places.select("place", "word", "n", "n_rows").mapInPandas(work, REPAIRS)


def many(texts: str, rows: str) -> Column:
    """How common something is: by texts, then by rows."""
    return F.struct(F.coalesce(texts, F.lit(0)).cast("long"), F.coalesce(rows, F.lit(0)).cast("long"))


def analysed(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(words of documents, possible repairs of places, twins, learned transformations).

    Twins: places whose word, repaired, stands there too and is the commoner one, there and in the whole corpus (where
    the bytes tell which of the two is garbled, it need not be the rarer one)."""
    words = cut(words_of(spread(documents.select("doc_id", "text"))))
    counts = (F.countDistinct("key").alias("n"), F.count("*").alias("n_rows"))
    places = cut(words.groupBy("place", "word").agg(*counts))
    lexicon = cut(words.groupBy("word").agg(*counts)).select("word", F.col("n").alias("n_all"), F.col("n_rows").alias("rows_all"))
    clean = lexicon.select(F.col("word").alias("repaired"), F.col("n_all").alias("n_clean"), F.col("rows_all").alias("rows_clean"))
    maybe = possible_repairs(places).join(lexicon, "word").join(clean, "repaired", "left")
    rarer = many("n_clean", "rows_clean") > many("n_all", "rows_all")
    maybe = cut(maybe.where(F.col("telling") | rarer))
    there = places.select("place", F.col("word").alias("repaired"), F.col("n").alias("n_repaired"), F.col("n_rows").alias("rows_repaired"))
    twins = cut(maybe.join(there, ["place", "repaired"]).where(F.col("telling") | ((many("n_repaired", "rows_repaired") > many("n", "n_rows")) & rarer)))
    votes = twins.groupBy("how").agg(F.count("*").alias("n_places"), F.countDistinct("word").alias("n_words"))
    alone = maybe.where("telling").groupBy("how").agg(F.countDistinct("word").alias("n_telling"))
    both = votes.join(alone, "how", "full").select("how", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_places", "n_words", "n_telling")])
    multi = F.substring_index("how", ">", 1).isin(*MULTI)
    learned = both.where(F.when(multi, (F.col("n_places") > 0) | (F.col("n_telling") >= SELF_SUPPORT)).otherwise(F.col("n_places") >= SUPPORT))
    return words, maybe, twins, cut(learned)


def one_script(word: str, repaired: str) -> bool:
    """Whether other than ASCII characters, none of them Cyrillic or Greek, become four letters or more of one of these
    scripts, with nothing else but quotes and dashes (a vowel and three different letters among them, capitals in front or
    throughout, no letter three times in a row, as lines of boxes have)."""
    if len(word) != len(repaired):
        return False
    pairs = [(g, c) for g, c in zip(word, repaired) if c >= "\x80" and c not in "«»“”„‘’–—…"]
    letters = "".join(c for _, c in pairs)
    script = {unicodedata.name(c, "").split(" ")[0] if c.isalpha() else "" for c in letters}
    if len(letters) < 4 or len(set(letters.lower())) < 3 or len(script) != 1 or not script <= {"CYRILLIC", "GREEK"}:
        return False
    if any(g < "\x80" or unicodedata.name(g, "").startswith(("CYRILLIC", "GREEK")) for g, _ in pairs) or any(c.isascii() and c.isalpha() for c in repaired):
        return False
    if not (letters[1:].islower() or letters.isupper()) or any(a == b == c for a, b, c in zip(letters, letters[1:], letters[2:])):
        return False
    plain = {unicodedata.normalize("NFD", c)[0] for c in letters.lower()}
    return bool(plain & set("аеиоуыэюяієαειουηω"))


def near(word: str, at: int) -> str:
    """A letter with its neighbours (blanks outside the word), small."""
    return f" {word} "[at : at + 3].lower()


def better_read(words: DataFrame, learned: DataFrame) -> DataFrame:
    """word, how, repaired, n_places: words that a learned transformation of single bytes makes readable. A letter between
    its neighbours counts by the texts that hold it."""
    hows = {r.how: r.n_places for r in learned.collect() if not many_bytes(r.how)}  # a row per hypothesis at most
    lexicon = words.select("word").distinct()

    def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(key, g) for key, w in b.itertuples(index=False) for g in {near(w, i) for i, c in enumerate(w) if c >= "\x80"}], columns=["key", "g"])

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w in b["word"]:
                for how, n in hows.items():
                    r = repair(w, *how.split(">"))
                    if r is None or len(r) != len(w):
                        continue
                    if one_script(w, r):
                        out.append((w, how, r, n, True, None, None))
                    elif len(w) >= 4 and all(c.isalpha() for g, c in zip(w, r) if g != c):
                        out += [(w, how, r, n, False, near(w, i), near(r, i)) for i, (g, c) in enumerate(zip(w, r)) if g != c]
            yield pd.DataFrame(out, columns=["word", "how", "repaired", "n_places", "script", "g", "c"])

    seen = words.select("key", "word").distinct().mapInPandas(letters, "key bigint, g string").groupBy("g").agg(F.countDistinct("key").alias("texts"))
    maybe = cut(lexicon.mapInPandas(candidates, "word string, how string, repaired string, n_places bigint, script boolean, g string, c string"))
    by_letters = maybe.where("NOT script").join(seen.withColumnRenamed("texts", "n_g"), "g", "left").join(seen.select(F.col("g").alias("c"), F.col("texts").alias("n_c")), "c", "left")
    better = (F.col("n_c") >= NEAR_TEXTS) & (F.col("n_c") >= NEAR_RATIO * F.coalesce("n_g", F.lit(0)))
    by_letters = by_letters.groupBy("word", "how", "repaired", "n_places").agg(F.min(F.coalesce(better, F.lit(False)).cast("int")).alias("better")).where("better = 1").drop("better")
    return maybe.where("script").select("word", "how", "repaired", "n_places").unionByName(by_letters)


def marked_words(words: DataFrame, maybe: DataFrame, twins: DataFrame, learned: DataFrame) -> DataFrame:
    """place, word, how, repaired of garbled words: those with a twin, those whose bytes tell, those whose repaired form is
    a clearly commoner word of three characters or more, and those that read better repaired. ``learned`` has at most a
    row per hypothesis."""
    known = F.broadcast(learned.select("how", "n_places"))
    cols = ("place", "word", "how", "repaired", "n_places")
    twice = (F.col("n_clean") >= 2 * F.col("n_all")) | ((F.col("n_clean") >= F.col("n_all")) & (F.col("rows_clean") >= 2 * F.col("rows_all")))
    by_word = maybe.join(known, "how").where(F.col("telling") | ((F.char_length("repaired") >= 3) & twice)).select(*cols)
    read = words.select("place", "word").distinct().join(better_read(words, learned), "word").select(*cols)
    return by_word.unionByName(twins.join(known, "how").select(*cols)).unionByName(read)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    words, maybe, twins, learned = analysed(d)
    bad = marked_words(words, maybe, twins, learned).select("place", "word").distinct()
    garbled = words.join(bad, ["place", "word"], "left_semi").select("doc_id")
    lost = d.where(F.col("text").contains(LOST)).select("doc_id")
    return garbled.union(lost).distinct()


def restore(text: str, words: dict[str, list[str]]) -> str:
    """Words that the documents' transformations garbled are decoded back; ``words``: transformations of each masked word,
    the best first."""
    import re

    how_many = sorted({h for hs in words.values() for h in hs if many_bytes(h)})

    def word(m: re.Match) -> str:
        w = m[0]
        if w.isascii():
            return w
        for h in words.get(re.sub("[0-9]", "0", w), []) + how_many:
            if (r := repair(w, *h.split(">"))) is not None:
                w = r
                break
        while True:  # each repair takes several characters for one, so it ends
            nxt = next((r for h in how_many if (r := repair(w, *h.split(">"))) is not None), None)
            if nxt is None or len(nxt) >= len(w):
                break
            w = nxt
        return w

    return re.sub(rf"[{UNSPACED}]+|[^ \t\r\n\f\x0b{UNSPACED}]+", word, text)


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, restored text, whether nothing is lost, of every garbled document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").dropDuplicates(["doc_id"])
    words, maybe, twins, learned = analysed(d)
    marks = marked_words(words, maybe, twins, learned).groupBy("place", "word").agg(F.array_sort(F.collect_set(F.struct((-F.col("n_places")).alias("k"), "how"))).alias("hows"))
    per = words.select("doc_id", "place", "word").distinct().join(marks, ["place", "word"]).groupBy("doc_id").agg(F.collect_set(F.struct("word", F.transform("hows", lambda h: h["how"]).alias("hows"))).alias("marks"))
    cases = d.join(per, "doc_id", "left").where(F.col("marks").isNotNull() | F.col("text").contains(LOST))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text, marks_ in b[["doc_id", "text", "marks"]].itertuples(index=False):
                r = restore(text, {m["word"]: list(m["hows"]) for m in marks_}) if marks_ is not None else text
                out.append((doc_id, r, LOST not in r))
            yield pd.DataFrame(out, columns=["doc_id", "restored", "complete"])

    return cases.mapInPandas(work, "doc_id bigint, restored string, complete boolean")


def p8_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned mappings: transformation, garbled and clean run of aligned twins, places that show it."""
    _, _, twins, learned = analysed(table(spark, sf_dir, "documents"))
    shown = twins.join(F.broadcast(learned.select("how")), "how").select("how", "word", "repaired")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(h, x, y) for h, w, r in b.itertuples(index=False) for x, y in align(w, r)], columns=["how", "garbled", "clean"])

    return shown.mapInPandas(work, "how string, garbled string, clean string").groupBy("how", "garbled", "clean").agg(F.count("*").alias("n_places"))


QUERIES = {"p8_found": p8_found, "p8_restored": p8_restored, "p8_mappings": p8_mappings}
SQL: dict[str, str] = {}
