"""One consistent form of texts that look the same but differ in their characters.

Words of the alphabets that share letter shapes are looked up in the corpus' own vocabulary: tries
of clean spellings are traversed by a weighted edit automaton in which a look-alike letter or an
ignorable character costs nothing. A word gets the spelling that the corpus uses most: in its form
one of the document's own alphabet, in its reading key the canonical one, which is the same for all
words that a trie takes for one (a Latin one before others). Letters that look like more than one
other, and those that come near another shape, are resolved by the vocabulary alone, and only in
words that mix alphabets. Words that no trie holds get the letters of the table; a table also folds
invisible characters, kinds of space and character widths outside of words, and composes accents.

Two texts read the same when their reading keys are equal. Case, visible accents, punctuation and
words stay different.

Defined cases: null and empty texts have a null or empty form; texts without a visible character
have a null reading key; repeated rows and equal texts each keep their row; an empty table gives
no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.session import cut, shuffle_width

# Letters that share the shape of a Latin letter.
CYRILLIC_LETTERS = "авеорсухіјѕһԁԛԝӏАВЕКМНОРСТУХІЈЅҺԌԚԜӀ"
CYRILLIC_SHAPES = "aʙeopcyxijshdqwlABEKMHOPCTYXIJShGQWI"
GREEK_LETTERS = "αικνορυχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ"
GREEK_SHAPES = "aiкvopuxyABEZHIKMNOPTYXCj"
ARMENIAN_LETTERS = "օոսհցզյՕՍԼ"
ARMENIAN_SHAPES = "onuhgqjOUL"
LATIN_LETTERS = "ɡɑıȷʟɩ"
LATIN_SHAPES = "gaijʟi"

SHAPE = {
    ord(a): b
    for letters, shapes in ((CYRILLIC_LETTERS, CYRILLIC_SHAPES), (GREEK_LETTERS, GREEK_SHAPES), (ARMENIAN_LETTERS, ARMENIAN_SHAPES), (LATIN_LETTERS, LATIN_SHAPES))
    for a, b in zip(letters, shapes, strict=True)
    if a != b
}

# Letters of mixed words that may stand for a Latin letter beside their shape's.
NEAR_LETTERS = "Ӏӏкκнтτмпηгьυωσ"
NEAR_SHAPES = "llkkhttmnnrbywo"
NEAR = dict(zip(NEAR_LETTERS, NEAR_SHAPES, strict=True))
# One letter for all that the shapes and the near letters may join; it only finds the trie to ask.
COARSE = {ord("I"): "l", ord("i"): "l", ord("к"): "k", ord("u"): "y"} | {ord(a): b for a, b in NEAR.items() if ord(a) not in SHAPE}


def _fold_table() -> dict[int, str | None]:
    """By rule: invisible characters go, spaces become one, wide, narrow and styled forms their plain one."""
    out: dict[int, str | None] = {}
    for c in range(0x20000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        parts = unicodedata.decomposition(ch).split()
        if kind == "Cf" or 0xFE00 <= c <= 0xFE0F or c in (0x034F, 0x115F, 0x1160, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0) or (kind == "Cc" and ch not in "\t\n\r"):
            out[c] = None
        elif kind == "Zs" or ch == "\t":
            if ch != " ":
                out[c] = " "
        elif len(parts) == 2 and parts[0] in ("<wide>", "<narrow>", "<font>"):
            out[c] = chr(int(parts[1], 16))
    out |= dict.fromkeys(range(0xE0100, 0xE01F0))
    return out


FOLD = _fold_table()
# Code point ranges: letters of the alphabets that share shapes, marks and ignorable characters
# that may stand inside a word, and whatever makes a text worth a closer look.
LETTER_RANGES = [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x370, 0x37D), (0x37F, 0x3FF), (0x400, 0x481), (0x48A, 0x52F), (0x531, 0x556), (0x561, 0x587), (0x1E00, 0x1FFF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0x1D400, 0x1D7FF)]
JOINED_RANGES = [(0x300, 0x36F), (0x483, 0x487), (0xAD, 0xAD), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x2069), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF)]
ODD_RANGES = [*JOINED_RANGES, (0x131, 0x131), (0x237, 0x237), (0x250, 0x2AF), (0x370, 0x3FF), (0x400, 0x52F), (0x531, 0x587), (0x1F00, 0x1FFF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0x1D400, 0x1D7FF)]


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


WORD = re.compile(f"[{_class(LETTER_RANGES)}][{_class(LETTER_RANGES + JOINED_RANGES)}]*")
ODD = re.compile(f"[{_class(ODD_RANGES)}]")
ODD_JVM = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ODD_RANGES) + "]"


def fold(text: str) -> str:
    """The table's form of a text, accents composed."""
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFC", text.translate(FOLD))


def shape(text: str) -> str:
    """Each letter of a folded text replaced by the first letter of its shape."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(SHAPE))


def script(ch: str) -> str:
    c = ord(ch)
    if 0x0400 <= c <= 0x052F:
        return "cyrillic"
    if 0x0370 <= c <= 0x03FF or 0x1F00 <= c <= 0x1FFF:
        return "greek"
    if 0x0531 <= c <= 0x0587:
        return "armenian"
    return "latin"


def scripts(word: str) -> set[str]:
    return {script(c) for c in word if c.isalpha()}


class Trie:
    """Clean spellings, decomposed, with how often the corpus has them."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, n: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", word):
            node = node.setdefault(c, {})
        node[""] = (n, word)

    def find(self, word: str, budget: int = 0, near: bool = False) -> list[tuple[int, int, str]]:
        """(cost, -count, spelling) of every spelling within `budget` edits of the word.

        States are trie nodes with their least cost. A look-alike or ignorable character is free,
        with `near` also a letter of NEAR; any other substitution, insertion or deletion costs one.
        """
        states: list[tuple[dict, int]] = [(self.root, 0)]
        for c in unicodedata.normalize("NFD", word):
            plain = FOLD.get(ord(c), c)
            if plain is None:
                continue
            want = SHAPE.get(ord(plain), plain)
            also = NEAR.get(plain, want) if near else want
            best: dict[int, tuple[dict, int]] = {}

            def step(node: dict, cost: int, best: dict[int, tuple[dict, int]] = best) -> None:
                if cost <= budget and (id(node) not in best or best[id(node)][1] > cost):
                    best[id(node)] = (node, cost)

            for node, cost in states:
                for k, child in node.items():
                    if k == "":
                        continue
                    step(child, cost + (SHAPE.get(ord(k), k) not in (want, also)))
                    if cost < budget:
                        for k2, deeper in child.items():
                            if k2 != "":
                                step(deeper, cost + 1 + (SHAPE.get(ord(k2), k2) not in (want, also)))
                step(node, cost + 1)
            states = list(best.values())
        for node, cost in states:  # grows while it is read: what a spelling has beyond the word's end
            if cost < budget:
                states.extend((child, cost + 1) for k, child in node.items() if k != "")
        return sorted((cost, -node[""][0], node[""][1]) for node, cost in states if "" in node)


def table_spelling(word: str, own: str) -> str:
    """The word in the letters of one alphabet, as far as the table goes."""
    w = fold(word)
    if scripts(w) == {own}:
        return w
    if own == "latin":
        got = shape(w)
        return got if scripts(got) == {"latin"} else w
    letters, shapes = {"cyrillic": (CYRILLIC_LETTERS, CYRILLIC_SHAPES), "greek": (GREEK_LETTERS, GREEK_SHAPES), "armenian": (ARMENIAN_LETTERS, ARMENIAN_SHAPES)}[own]
    back = {ord(s): a for a, s in zip(letters, shapes, strict=True)}
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", shape(w)).translate(back))


TAKEN = set(SHAPE.values())


def _main_script(words: list[str]) -> str:
    """The alphabet of most letters that no other one imitates; of most letters where there are none."""
    sure: Counter = Counter()
    every: Counter = Counter()
    for c, n in Counter("".join(words)).items():
        p = FOLD.get(ord(c), c)
        if p and p.isalpha():
            every[script(p)] += n
            if ord(p) not in SHAPE and p not in TAKEN:
                sure[script(p)] += n
    n = sure or every
    return min(n, key=lambda k: (-n[k], k)) if n else "latin"


def _clean(word: str) -> bool:
    return word.isascii() or (fold(word) == word and len(scripts(word)) == 1 and not any(c in LATIN_LETTERS for c in word))


def suspects(words: list[str], main: str) -> set[str]:
    """Words that may be disguised: unclean ones, and those of another alphabet whose every letter has a look-alike."""
    out = set()
    for w in set(words):
        if not _clean(w):
            out.add(w)
        elif main != "latin" or not w.isascii():
            if scripts(w) != {main} and scripts(table_spelling(w, main)) == {main}:
                out.add(w)
    return out


def shared_shape(words: list[str]) -> set[str]:
    """Words of other alphabets whose every letter has a Latin look-alike: a Latin spelling may be the canonical one."""
    return {w for w in set(words) if not w.isascii() and "latin" not in scripts(w) and scripts(shape(fold(w))) == {"latin"}}


def _survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of clean spellings, and the distinct suspects of each text with its main alphabet."""
    names = ["key", "script", "word", "n"]
    count: Counter = Counter()
    for b in batches:
        keys, mains, found = [], [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = WORD.findall(text)
            count.update(words)
            if ODD.search(text):
                main = _main_script(words)
                for w in suspects(words, main) | shared_shape(words):
                    keys.append(key)
                    mains.append(main)
                    found.append(w)
        if found:
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(mains, pa.string()), pa.array(found, pa.string()), pa.array([0] * len(found), pa.int64())], names)
        if len(count) > 100_000:
            yield _counts(count, names)
            count = Counter()
    if count:
        yield _counts(count, names)


def _counts(count: Counter, names: list[str]) -> pa.RecordBatch:
    kept = [(w, n) for w, n in count.items() if _clean(w)]
    none = pa.nulls(len(kept), pa.string())
    return pa.record_batch([none, none, pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names)


def skeleton(word: str) -> str:
    """What all words have in common that a trie may take for one."""
    return shape(fold(word)).translate(COARSE)


def _with_skeleton(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([pa.array([skeleton(w) for w in b.column(0).to_pylist()], pa.string()), b.column(0), b.column(1)], ["shape", "word", "n"])


def spellings(trie: Trie, word: str) -> dict[str, str]:
    """The most frequent spelling per alphabet that a trie has for a word, and under "" the canonical one."""
    found = trie.find(word) or ([] if _clean(word) else trie.find(word, near=True))
    best: dict[str, tuple[int, str]] = {}
    for _, n, spelling in found:
        own = next(iter(scripts(spelling)), "latin")
        best[own] = min(best.get(own, (1, "")), (n, spelling))
    out = {k: v for k, (_, v) in best.items()}
    return out | {"": out.get("latin") or min(best.values())[1]} if best else {}


def _resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spellings of each asked word (n = 0) from the trie of the clean words of its skeletons."""
    held: str | None = None
    trie, asked = Trie(), []

    def answer() -> pa.RecordBatch:
        rows = [(w, s, x) for w in asked for s, x in spellings(trie, w).items()]
        return pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["word", "script", "spelling"])

    for b in batches:
        for sh, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held != sh[:2]:  # a trie for each two first letters of the partition's share
                if asked:
                    yield answer()
                held, trie, asked = sh[:2], Trie(), []
            if n:
                trie.add(word, n)
            else:
                asked.append(word)
    if asked:
        yield answer()


def _rewrite(text: str, spelling: dict[str, str]) -> str:
    if spelling:
        text = WORD.sub(lambda m: spelling.get(m.group(), m.group()), text)
    return fold(text)


def _forms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = lambda t: hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest()
    for b in batches:
        forms, keys, raws = [], [], []
        for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if text is None:
                forms.append(None)
                keys.append(None)
                raws.append(None)
                continue
            own = {f["word"]: f["spelling"] for f in found or () if f["script"]}
            canon = {f["word"]: f["spelling"] for f in found or () if not f["script"]}
            if ODD.search(text):  # the table, for words that no trie held
                words = WORD.findall(text)
                main = _main_script(words)
                for w in suspects(words, main):
                    if w not in own:
                        own[w] = table_spelling(w, main)
                for w in set(words):
                    if w not in canon and not _clean(w):
                        canon[w] = shape(fold(w))
            seen = _rewrite(text, canon)
            forms.append(_rewrite(text, own))
            keys.append(digest(seen) if seen.strip() else None)
            raws.append(digest(text))
        yield pa.record_batch([b.column(0), pa.array(forms, pa.string()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["key", "form", "reading", "raw"])


def consistent_forms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, form, reading, raw): the consistent text, its reading key, and a digest of the original.

    Words are counted over all texts. Asked words meet the vocabulary by their skeletons, hashed over
    the partitions, never as a broadcast. Only texts with an unusual character are shuffled back to
    their spellings; all others are folded where they are read.
    """
    width = shuffle_width(df.sparkSession)
    t = df.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    seen = cut(t.where(F.col("text").isNotNull()).mapInArrow(_survey, "key string, script string, word string, n long"))
    vocabulary = seen.where(F.col("n") > 0).groupBy("word").agg(F.sum("n").alias("n"))
    wanted = seen.where(F.col("n") == 0).select("key", F.col("script").alias("main"), "word").distinct()
    asked = wanted.select("word", F.lit(0).cast("long").alias("n")).distinct()
    both = vocabulary.unionByName(asked).mapInArrow(_with_skeleton, "shape string, word string, n long")
    found = both.repartition(width, "shape").sortWithinPartitions("shape").mapInArrow(_resolve, "word string, script string, spelling string")
    per = wanted.join(found, "word").where(F.col("script").isin("") | (F.col("script") == F.col("main")))
    per = per.groupBy("key").agg(F.collect_list(F.struct("word", "script", "spelling")).alias("found"))
    odd = F.coalesce(F.col("text").rlike(ODD_JVM), F.lit(False))
    none = F.lit(None).cast("array<struct<word: string, script: string, spelling: string>>")
    plain = t.where(~odd).select("key", "text", none.alias("found"))
    rest = t.where(odd).join(per, "key", "left").select("key", "text", "found")
    schema = "key string, form string, reading binary, raw binary"
    return plain.mapInArrow(_forms, schema).unionByName(rest.mapInArrow(_forms, schema))


HOT_TEXTS = 1000  # most texts whose many copies are salted


def same_reading(forms: DataFrame) -> DataFrame:
    """(a, b) of rows that read the same and differ in their characters; a < b as numbers.

    Distinct originals of a reading are paired first; only then the rows of each original come in,
    those of many copies salted, so no more rows are made than come out.
    """
    # written once, without the texts
    r = cut(forms.where(F.col("reading").isNotNull()).select(F.col("key").cast("long").alias("id"), "reading", "raw"))
    several = r.groupBy("reading").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where(F.col("lo") != F.col("hi")).select("reading")
    rows = cut(r.join(several, "reading"))
    texts = rows.groupBy("reading", "raw").agg(F.count("*").alias("n"))
    pairs = texts.select("reading", F.col("raw").alias("ra")).join(texts.select("reading", F.col("raw").alias("rb")), "reading").where(F.col("ra") < F.col("rb")).select("ra", "rb")
    share = max(100_000, rows.count() // HOT_TEXTS)
    hot = F.broadcast(texts.where(F.col("n") > share).select("raw", F.ceil(F.col("n") / share).cast("int").alias("salts")))  # at most HOT_TEXTS
    salts = F.coalesce("salts", F.lit(1))
    member = rows.join(hot, "raw", "left").select("raw", "id", F.pmod(F.hash("id"), salts).alias("salt"))
    for side, out in (("ra", "a"), ("rb", "b")):
        spread = pairs.withColumnRenamed(side, "raw").join(hot, "raw", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        pairs = spread.join(member, ["raw", "salt"]).drop("raw", "salt").withColumnRenamed("id", out)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
