"""Languages of texts and of their segments by prediction by partial matching.

For each language a tree of byte contexts (up to three bytes) with escape probabilities (method C)
is frozen after training; the code length of every byte under every language follows. Lengths are
summed by word; the language with the least total is the text's, and runs of words that another
language codes far shorter are segments of their own. All languages are scored at once: a
text's bytes become n-gram numbers, and one table lookup per byte gives the lengths of all.

Training takes a bounded sample of labelled rows (SAMPLE_* rows per language, in the order of a
hash); all rows are scored alike.

Defined cases: null and blank texts, and texts without a word that shows a language (names,
numbers and signs only), have no language and no segment; text in an unknown language gets the
nearest one, with its confidence; repeated texts are scored once and keep all their rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGES = ["de", "en", "es", "fr", "it", "ja", "ko", "ru"]
SAMPLE_DOCUMENTS = 500
SAMPLE_TITLES = 1500
SAMPLE_QUERIES = 1500
TERM_FILMS = 10_000  # a genre or keyword term counts as borrowed if one of so many films has it; so there are at most as many times the terms of a film

ORDER = 4  # longest n-gram: a context of three bytes and the byte itself
SEGMENT_BITS = 24.0  # least that a segment must save against its surroundings
SEGMENT_WORDS = 3
UNKNOWN_WEIGHT = 0.3  # of words that no language's training texts know: mostly names, which tell little

# Two-letter codes of languages.
CODES = set(
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu".split()
)
# Other notations of languages.
NOTATIONS = dict(
    x.split(":")
    for x in "eng:en fra:fr fre:fr spa:es deu:de ger:de ita:it jpn:ja rus:ru kor:ko por:pt nld:nl dut:nl pol:pl swe:sv zho:zh chi:zh ara:ar tur:tr ces:cs cze:cs dan:da fin:fi hun:hu ukr:uk ell:el gre:el heb:he hin:hi tha:th vie:vi nor:no ron:ro rum:ro english:en french:fr spanish:es german:de italian:it japanese:ja russian:ru korean:ko portuguese:pt anglais:en français:fr francais:fr español:es espanol:es castellano:es deutsch:de italiano:it 日本語:ja русский:ru 한국어:ko jp:ja kr:ko".split()
)

WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+['’]?|[Ѐ-ӿ]+|[぀-ヿ々一-鿿]+|[가-힣]+")
QUOTED = re.compile(r"«[^«»]{1,120}»|“[^“”]{1,120}”|„[^„“”]{1,120}[“”]|「[^「」]{1,80}」|『[^『』]{1,80}』|\"[^\"]{1,120}\"")
QUOTED_WORDS = 10  # a longer quotation is text of its own
SHOWS_JA = re.compile(r"[぀-ゟ一-鿿]")


def label_code(label: str | None) -> str | None:
    """The two-letter code of a label in any notation; None when it names no language."""
    if label is None:
        return None
    x = re.split(r"[-_]", label.strip().lower())[0]
    return NOTATIONS.get(x) or (x if x in CODES else None)


def label_column(c):  # noqa: ANN001, ANN201
    """The same on columns."""
    head = F.split(F.lower(F.trim(c)), "[-_]")[0]
    table = F.create_map(*[F.lit(v) for kv in sorted({**{k: k for k in CODES}, **NOTATIONS}.items()) for v in kv])
    return F.try_element_at(table, head)


SCRIPTS = {"ja": re.compile("[぀-ヿ々一-鿿]"), "ko": re.compile("[가-힣]"), "ru": re.compile("[Ѐ-ӿ]")}
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")


def in_script(text: str, lang: str) -> bool:
    """Whether at least half of a text's letters are of the language's script; others cannot teach it."""
    own = len(SCRIPTS.get(lang, LATIN).findall(text))
    return own > 0 and 2 * own >= sum(c.isalpha() for c in text)


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def words_of(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group().lower().replace("’", "'")) for m in WORD.finditer(text)]


def _stream(texts: Iterable[list[str]]) -> bytes:
    return b"   " + b"   ".join(" ".join(t).encode() for t in texts) + b"   "


def _grams(raw: np.ndarray, n: int) -> np.ndarray:
    """Number of the n bytes that end at each position; the first n - 1 positions are short."""
    g = raw.astype(np.uint32)
    out = g.copy()
    for k in range(1, n):
        out[k:] |= g[:-k] << np.uint32(8 * k)
    return out


class Lookup:
    """Row number of a gram, by open addressing; -1 when it is not there."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        self.keys = keys.astype(np.uint32)
        at, todo = self._hash(self.keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.slot[at[todo]] < 0
            cand = todo[free]
            _, first = np.unique(at[cand], return_index=True)
            self.slot[at[cand[first]]] = cand[first]
            placed = np.zeros(len(keys), bool)
            placed[cand[first]] = True
            todo = todo[~placed[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def _hash(self, g: np.ndarray) -> np.ndarray:
        return ((g * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def find(self, g: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(g), -1, np.int32)
        at = self._hash(g)
        row = self.slot[at]
        ok = (row >= 0) & (self.keys[row] == g)
        out = np.where(ok, row, -1).astype(np.int32)
        todo = np.nonzero(~ok & (row >= 0))[0]
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
            row = self.slot[at[todo]]
            hit = (row >= 0) & (self.keys[row] == g[todo])
            out[todo[hit]] = row[hit]
            todo = todo[~hit & (row >= 0)]
        return out


class Model:
    """Frozen context trees of all languages, and the words that show each."""

    def __init__(self, texts: dict[str, list[str]], terms: Iterable[str] = ()) -> None:
        n = len(LANGUAGES)
        streams, counts, spread = [], [], []
        for lang in LANGUAGES:
            ws = [[w for _, _, w in words_of(t)] for t in texts.get(lang, [])]
            ws = [w for w in ws if w]
            streams.append(np.frombuffer(_stream(ws) + _stream([[_plain(x) for x in w] for w in ws if lang not in ("ja", "ko", "ru")]), np.uint8))
            c: Counter = Counter()
            for t in texts.get(lang, []):
                c.update({m.lower().replace("’", "'") for m in WORD.findall(t)})
            counts.append(c)
            spread.append(max(1, len(ws)))
        final: np.ndarray | None = None
        escape: list[np.ndarray] = []
        self.lookup: dict[int, Lookup] = {}
        self.final: dict[int, np.ndarray] = {}
        for k in range(1, ORDER + 1):
            got = [np.unique(_grams(s, k)[ORDER:], return_counts=True) for s in streams]
            if k == ORDER:  # a longest n-gram seen once anywhere tells nothing that its suffix does not
                every, total = np.unique(np.concatenate([g for g, _ in got]), return_inverse=True)
                times = np.bincount(total, weights=np.concatenate([c for _, c in got]))
                grams = every[times > 1]
                got = [(g[k_], c[k_]) for g, c in got for k_ in (np.isin(g, grams, assume_unique=True),)]  # nor does it count in its context
            else:
                grams = np.unique(np.concatenate([g for g, _ in got]))
            seen = np.zeros((len(grams), n))
            whole: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for i, (g, c) in enumerate(got):
                at = np.searchsorted(grams, g)
                ok = (at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] == g)
                seen[at[ok], i] = c[ok]
                ctx, inv = np.unique(g >> np.uint32(8), return_inverse=True)
                whole[i] = (ctx, np.bincount(inv, weights=c), np.bincount(inv).astype(float))
            ctxs = grams >> np.uint32(8)
            tot, kinds = np.zeros((len(grams), n)), np.zeros((len(grams), n))
            for i, (ctx, t, d) in whole.items():
                if not len(ctx):
                    continue
                at = np.minimum(np.searchsorted(ctx, ctxs), len(ctx) - 1)
                ok = ctx[at] == ctxs
                tot[ok, i], kinds[ok, i] = t[at[ok]], d[at[ok]]
            with np.errstate(divide="ignore", invalid="ignore"):
                direct = -np.log2(seen / (tot + kinds))
                esc = np.where(tot > 0, -np.log2(kinds / (tot + kinds)), 0.0)
            if k == 1:
                below = np.full((len(grams), n), 8.0)
            else:
                below = self._known(grams & np.uint32((1 << (8 * (k - 1))) - 1), k - 1)
            cost = np.where(seen > 0, direct, esc + below)
            self.lookup[k], self.final[k] = Lookup(grams), cost.astype(np.float32)
            # escape lengths of the contexts of this order, kept by the context's own gram
            if k > 1:
                keys = self.lookup[k - 1].keys
                out = np.zeros((len(keys), n), np.float32)
                for i, (ctx, t, d) in whole.items():
                    if not len(ctx):
                        continue
                    at = np.minimum(np.searchsorted(ctx, keys), len(ctx) - 1)
                    ok = ctx[at] == keys
                    out[ok, i] = -np.log2(d[at[ok]] / (t[at[ok]] + d[at[ok]]))
                escape.append(out)
            final = cost
        self.escape = escape
        self.words: list[set[str]] = []
        for i, lang in enumerate(LANGUAGES):
            least = max(3, spread[i] // 400)
            lower = {w for t in texts.get(lang, []) for w in (x.replace("’", "'") for x in WORD.findall(t)) if w == w.lower()}
            self.words.append({w for w, c in counts[i].items() if c >= least and (w in lower or c >= max(8, spread[i] // 100))})
        self.known = set().union(*self.words)
        self.terms = {tuple(w for _, _, w in words_of(t)) for t in terms}
        self.term_heads: dict[str, list[tuple[str, ...]]] = {}
        for t in sorted(self.terms, key=lambda t: (-len(t), t)):
            if t:
                self.term_heads.setdefault(t[0], []).append(t)

    def _known(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Code lengths of the last byte of each gram of k bytes, escaping to shorter contexts where it is new."""
        if k == 0:
            return np.full((len(grams), len(LANGUAGES)), 8.0, np.float32)
        row = self.lookup[k].find(grams)
        out = self.final[k][np.maximum(row, 0)]
        new = np.nonzero(row < 0)[0]
        if len(new):
            g = grams[new]
            low = self._known(g & np.uint32((1 << (8 * (k - 1))) - 1), k - 1)
            if k > 1:
                at = self.lookup[k - 1].find(g >> np.uint32(8))
                low = low + np.where((at >= 0)[:, None], self.escape[k - 2][np.maximum(at, 0)], 0)
            out[new] = low
        return out

    def word_lengths(self, texts: list[list[str]]) -> np.ndarray:
        """Bits of each word (with the space after it) in each language, for all words of all texts."""
        raw = _stream(texts)
        n = np.fromiter((len(w.encode()) for t in texts for w in t), np.int64)
        gap = np.ones(len(n), np.int64)
        at = 0
        for t in texts:
            at += len(t)
            if t:
                gap[at - 1] = 3
        empties = [i for i, t in enumerate(texts) if not t]
        if empties:
            raise ValueError("texts without words are not scored")
        begin = 3 + np.r_[0, np.cumsum(n + gap)[:-1]]
        bits = self._known(_grams(np.frombuffer(raw, np.uint8), ORDER), ORDER)
        total = np.r_[np.zeros((1, len(LANGUAGES)), np.float32), np.cumsum(bits, axis=0, dtype=np.float64)]
        return total[begin + n + 1] - total[begin]

    def borrowed(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), bool)
        for i, w in enumerate(words):
            for t in self.term_heads.get(w, ()):
                if tuple(words[i : i + len(t)]) == t:
                    out[i : i + len(t)] = True
                    break
        return out

    def shows(self, words: list[str], lang: int, other: int | None = None) -> int:
        """How many of the words show the language (and not the other one)."""
        code = LANGUAGES[lang]
        if code == "ja":
            n = sum(len(SHOWS_JA.findall(w)) for w in words)
            return n if other is None else n // 2
        if code in ("ko", "ru"):
            own = [w for w in words if ("가" <= w[0] <= "힣") == (code == "ko") and (w[0] > "͏")]
            known = sum(w in self.words[lang] for w in own)
            return max(known, len(own) - 1)
        if other is None:
            return sum(w in self.words[lang] for w in words)
        return sum(w in self.words[lang] and w not in self.words[other] for w in words)


def _segments(model: Model, words: list[str], bits: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, int, float]]:
    """(first word, end word, language, confidence) of the words lo..hi, cut where another language pays."""
    part = bits[lo:hi]
    total = part.sum(axis=0)
    best = int(total.argmin())
    gain = part[:, best : best + 1] - part
    reach = np.maximum(gain, 0).sum(axis=0)
    reach[best] = 0
    if reach.max() >= SEGMENT_BITS and hi - lo > SEGMENT_WORDS:
        run = np.r_[np.zeros((1, part.shape[1])), np.cumsum(gain, axis=0)]
        low = np.minimum.accumulate(run, axis=0)
        save = run - low
        save[:, best] = 0
        for lang in np.argsort(-save.max(axis=0), kind="stable")[:2]:
            end = int(save[:, lang].argmax())
            if save[end, lang] < SEGMENT_BITS:
                break
            begin = int(np.nonzero(run[: end + 1, lang] == low[end, lang])[0][-1])
            inner, outer = words[lo + begin : lo + end], words[lo : lo + begin] + words[lo + end : hi]
            if end - begin >= hi - lo or model.shows(inner, int(lang), best) < 2 or (len(inner) < SEGMENT_WORDS and LANGUAGES[lang] != "ja"):
                continue
            if model.shows(outer, best, int(lang)) < 2:
                continue
            out = []
            for a, b in ((lo, lo + begin), (lo + begin, lo + end), (lo + end, hi)):
                if b > a:
                    out += _segments(model, words, bits, a, b)
            return out
    odds = np.exp2(-(total - total[best]).clip(0, 60))
    return [(lo, hi, best, float(odds[best] / odds.sum()))]


def _settled(segs: list[tuple[int, int, int, float]], bits: np.ndarray, mask: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Segments of fewer than SEGMENT_WORDS words take the language of the neighbour that codes them shorter.

    A run of one script, as of Japanese, may be a single word; where no neighbour comes near it, it stays.
    """
    if len(segs) < 2:
        return segs
    out = []
    for i, (a, z, lang, conf) in enumerate(segs):
        if (~mask[a:z]).sum() < SEGMENT_WORDS:
            own = bits[a:z].sum(axis=0)
            other = min((segs[j][2] for j in (i - 1, i + 1) if 0 <= j < len(segs)), key=lambda k: (own[k], k))
            if own[other] - own[lang] < 2 * SEGMENT_BITS:
                lang = other
        out.append((a, z, lang, conf))
    return out


def label(model: Model, texts: list[str | None]) -> list[tuple[list[tuple[int, int, str, float]], list[str]]]:
    """Segments (start, end, language, confidence) and the languages shown, for each text."""
    out: list = [([], []) for _ in texts]
    rows, spans, words = [], [], []
    for i, t in enumerate(texts):
        ws = words_of(t) if t else []
        if ws:
            rows.append(i)
            spans.append(ws)
            words.append([w for _, _, w in ws])
    if not rows:
        return out
    bits = model.word_lengths(words)
    ends = np.cumsum([len(w) for w in words])
    for i, sp, ws, end in zip(rows, spans, words, ends, strict=True):
        b = bits[end - len(ws) : end]
        mask = model.borrowed(ws)
        for m in QUOTED.finditer(texts[i]) if any(q in texts[i] for q in "«“„「『\"") else ():
            inside = [k for k, (s, _, _) in enumerate(sp) if m.start() <= s < m.end()]
            if len(inside) <= QUOTED_WORDS and len(inside) < len(ws):
                mask[inside] = True
        kept = [w for w, x in zip(ws, mask, strict=True) if not x] or ws
        weight = np.fromiter((1.0 if w in model.known else UNKNOWN_WEIGHT for w in ws), float, len(ws))
        use = b * (weight if mask.all() else np.where(mask, 0.0, weight))[:, None]
        shown = list(ws) if mask.all() else [w if not x else "-" for w, x in zip(ws, mask, strict=True)]
        segs = _segments(model, shown, use, 0, len(ws))
        merged: list[list] = []
        for a, z, lang, conf in _settled(segs, use, mask):
            if merged and merged[-1][2] == lang:
                merged[-1][1], merged[-1][3] = z, max(merged[-1][3], conf)
            else:
                merged.append([a, z, lang, conf])
        langs = sorted({LANGUAGES[lang] for a, z, lang, _ in merged if model.shows([w for w in shown[a:z] if w != "-"] if len(merged) > 1 else kept, lang) >= (2 if len(merged) > 1 else 1)})
        if langs:
            out[i] = ([(sp[a][0], sp[z - 1][1], LANGUAGES[lang], conf) for a, z, lang, conf in merged], langs)
    return out


RESULT = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("langs", T.ArrayType(T.StringType())),
    T.StructField("segments", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]))),
])
_SEGMENT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])


def _label_batches(shared):  # noqa: ANN001
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(0).to_pylist()
            got, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t or "")
                if size > 400_000:
                    got += label(model, part)
                    part, size = [], 0
            got += label(model, part)
            segs = [[{"start": s, "end": e, "lang": x, "confidence": c} for s, e, x, c in g[0]] for g in got]
            yield pa.record_batch([b.column(0), pa.array([g[1] for g in got], pa.list_(pa.string())), pa.array(segs, pa.list_(_SEGMENT))], ["text", "langs", "segments"])

    return run


def label_texts(texts: DataFrame, model: Model) -> DataFrame:
    """(text, langs, segments) for each row of a one-column DataFrame of texts; the model is broadcast, its size is that of the bounded training sample."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    return texts.toDF("text").mapInArrow(_label_batches(shared), RESULT)


def _sample(df: DataFrame, text: str, lang, per: int) -> DataFrame:  # noqa: ANN001
    """At most `per` distinct texts of each language, in the order of a hash."""
    from pyspark.sql import Window

    t = df.select(F.col(text).alias("text"), lang.alias("lang")).where(F.col("lang").isin(LANGUAGES) & (F.length(F.trim("text")) > 0)).distinct()
    w = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    return t.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per).select("lang", "text")


def train(documents: DataFrame, films: DataFrame, queries: DataFrame) -> Model:
    """The frozen model of the film corpus, from bounded samples of labelled rows.

    A first model of documents and titles checks the labels of the sampled queries; those that
    it confirms join the final training set.
    """
    docs = _sample(documents, "text", label_column(F.col("lang")), SAMPLE_DOCUMENTS).withColumn("kind", F.lit("d"))
    titles = _sample(films, "original_title", label_column(F.col("original_language")), SAMPLE_TITLES).withColumn("kind", F.lit("t"))
    asks = _sample(queries, "query_text", label_column(F.col("lang")), SAMPLE_QUERIES).withColumn("kind", F.lit("q"))
    terms = films.select(F.explode(F.array_distinct(F.concat(F.coalesce("genres", F.array()), F.coalesce("keywords", F.array())))).alias("text")).groupBy("text").count()
    terms = terms.where(F.col("count") * TERM_FILMS >= films.count()).select(F.lit("").alias("lang"), "text", F.lit("k").alias("kind"))
    rows = docs.unionByName(titles).unionByName(asks).unionByName(terms).collect()  # at most 8 x (500 + 1500 + 1500) rows and the terms
    rows = sorted((r for r in rows if r["kind"] == "k" or in_script(r["text"], r["lang"])), key=lambda r: (r["kind"], r["lang"], r["text"]))
    borrowed = [r["text"] for r in rows if r["kind"] == "k" and r["text"]]
    base: dict[str, list[str]] = {}
    for r in rows:
        if r["kind"] in "dt":
            base.setdefault(r["lang"], []).append(r["text"])
    first = Model(base, borrowed)
    asked = [r for r in rows if r["kind"] == "q"]
    for r, (_, langs) in zip(asked, label(first, [r["text"] for r in asked]), strict=True):
        if langs == [r["lang"]]:
            base[r["lang"]].append(r["text"])
    checked: dict[str, list[str]] = {}
    for lang, texts in base.items():  # titles under a wrong label, documents with a second language
        for t, (_, langs) in zip(texts, label(first, texts), strict=True):
            if not langs or langs == [lang]:
                checked.setdefault(lang, []).append(t)
    return Model(checked, borrowed)
