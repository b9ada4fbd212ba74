"""Cleaning and normalising as Column functions (FUN-01..24, 27, 28, 33, 35..41).

Every function tolerates nulls and malformed input: it gives null or the default, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKENS = ["", "NA", "N/A", "null", "None"]
# Texts that stand for no text.
PLACEHOLDERS = ["no overview", "no description", "n/a"]
# Labels before a critics' text, removed in this order.
CONSENSUS_LABELS = ["Critics Consensus:", "Critics Consensus", "Critic's Consensus:"]
# Synonyms of score states.
STATES = {"fresh": "fresh", "certified_fresh": "certified_fresh", "certified-fresh": "certified_fresh", "rotten": "rotten", "positive": "fresh", "negative": "rotten", "upright": "fresh", "spilled": "rotten"}
FRENCH_TRANSLATIONS = ["FR", "BE", "CA"]
FRENCH_TITLES = ["FR", "BE", "CA", "CH", "LU"]
# Words too common in a film corpus to search for.
NOISE_WORDS = ["film", "films", "movie", "movies", "cinema", "cinéma", "horreur", "horror", "épouvante", "epouvante"]
ACCENTED = "àáâãäåèéêëìíîïòóôõöøùúûüçñýÿÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiioooooouuuucnyyAAAAAAEEEEIIIIOOOOOOUUUUCNY"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_string(c: Column) -> Column:
    """FUN-10: stripped; empty is null."""
    s = strip(c)
    return F.when(s != "", s)


def null_token(c: Column) -> Column:
    """SRC-02: any of five spellings of nothing is null."""
    return F.when(~c.isin(NULL_TOKENS), c)


def clean_text(c: Column, least: int = 10) -> Column:
    """FUN-11: placeholders and texts of up to `least` characters are null."""
    s = strip(c)
    return F.when(~F.lower(s).isin(PLACEHOLDERS) & (F.length(s) > least), s)


def clean_language(c: Column) -> Column:
    """FUN-12: exactly two characters, lower case."""
    s = F.lower(strip(c))
    return F.when(F.length(s) == 2, s)


def safe_int(c: Column, default: int = 0) -> Column:
    """FUN-05: whole numbers from 0; anything else, also '3.9' as text, is the default."""
    s = strip(c.cast("string"))
    n = F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("long"))
    return F.when(n >= 0, n).otherwise(F.lit(default).cast("long"))


def safe_positive(c: Column) -> Column:
    """FUN-06: whole numbers from 1, else null."""
    n = safe_int(c, 0)
    return F.when(n > 0, n)


def safe_float(c: Column, digits: int | None = None, default: float | None = None) -> Column:
    """FUN-07: a number, rounded half up where digits are given."""
    x = c.cast("string").try_cast("double")
    x = x if digits is None else F.round(x, digits)
    return F.coalesce(x, F.lit(default).cast("double"))


def in_range(c: Column, lo: float, hi: float) -> Column:
    """FUN-08 (runtime 1..600 or 1..1000), FUN-09 (percent 0..100): null outside."""
    return F.when(c.between(lo, hi), c)


def iso_date(c: Column) -> Column:
    """FUN-03: extended or basic ISO dates; anything else is null."""
    s = strip(c)
    basic = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(basic.rlike(r"^\d{4}-\d{2}-\d{2}$"), basic.try_cast("date"))


def date_or_year(c: Column, lo: int = 1900, hi: int = 2100) -> Column:
    """FUN-04: an ISO date, or a bare year as its first of January."""
    y = F.when(strip(c).rlike(r"^\d{4}$"), strip(c).try_cast("int"))
    return F.coalesce(iso_date(c), F.when(y.between(lo, hi), F.make_date(y, F.lit(1), F.lit(1))))


def year_of(c: Column) -> Column:
    """FUN-02: first four characters of an ISO text; empty or null is null."""
    y = F.substring(c, 1, 4)
    return F.when(y != "", y)


def state(c: Column) -> Column:
    """FUN-14: synonyms to one name; unknown states stay, in lower case."""
    s = strip(F.lower(c))
    table = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return F.when(s != "", F.coalesce(F.try_element_at(table, s), s))


def consensus(c: Column, least: int = 20) -> Column:
    """FUN-15: without leading labels; placeholders and short texts are null."""
    t = strip(c)
    for p in CONSENSUS_LABELS:
        t = F.when(t.startswith(p), strip(F.substring(t, len(p) + 1, 1_000_000_000))).otherwise(t)
    return F.when(~F.contains(F.lower(t), F.lit("no consensus yet")) & (F.length(t) > least), t)


def is_certified(c: Column) -> Column:
    return F.coalesce(state(c) == "certified_fresh", F.lit(False))


def is_fresh(score: Column) -> Column:
    """FUN-16: from 60; no score is not fresh."""
    return F.coalesce(score >= 60, F.lit(False))


def is_rotten(score: Column) -> Column:
    return F.coalesce(score < 60, F.lit(False))


def valid_imdb(c: Column, strict: bool = True) -> Column:
    """FUN-17: tt and digits; 7 or 8 of them where strict."""
    return F.coalesce(c.rlike(r"^tt\d{7,8}$" if strict else r"^tt\d+$"), F.lit(False))


def slug(title: Column) -> Column:
    """FUN-18: lower case, no leading article, letters and digits of any script joined by underscores."""
    s = F.regexp_replace(F.lower(title), r"^(the|a|an)\s+", "")
    s = F.replace(F.replace(s, F.lit("'"), F.lit("")), F.lit("&"), F.lit("and"))
    s = F.regexp_replace(s, r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[-\s]+", "_"), r"_+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


def url_variants(title: Column, year: Column) -> Column:
    """FUN-19: distinct candidate paths in order: plain, with year, with the article, with digits for numerals.

    A numeral replaces every place where its letters stand in the slug, as titles with ' v' show.
    """
    base, low = slug(title), F.lower(title)
    the = slug(F.concat(F.lit("the_"), F.substring(title, 5, 1_000_000)))
    dated = lambda s: F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(F.lit("/m/"), s, F.lit("_"), year.cast("string")))
    items = [F.concat(F.lit("/m/"), base), dated(base), F.when(low.startswith("the "), F.concat(F.lit("/m/"), the)), F.when(low.startswith("the "), dated(the))]
    for n, roman in enumerate(["ii", "iii", "iv", "v", "vi", "vii", "viii"], 2):
        items.append(F.when(F.contains(low, F.lit(" " + roman)), F.concat(F.lit("/m/"), F.replace(base, F.lit(roman), F.lit(f"_{n}")))))
    return F.array_distinct(F.array_compact(F.array(*items)))


def search_url(base: str, title: Column, year: Column) -> Column:
    """FUN-20: form-encoded query of title and year."""
    q = F.when(F.coalesce(year, F.lit(0)) != 0, F.concat_ws(" ", title, year.cast("string"))).otherwise(title)
    return F.concat(F.lit(base + "/search?search="), F.url_encode(q))


def slug_of_url(url: Column) -> Column:
    s = F.regexp_extract(url, r"/m/([^/?#]+)", 1)
    return F.when(s != "", s)


def split_list(c: Column) -> Column:
    """FUN-21: comma list to trimmed items, blanks dropped; null gives none."""
    return F.coalesce(F.filter(F.transform(F.split(c, ","), strip), lambda x: x != ""), F.array().cast("array<string>"))


def french(translations: Column, field: str) -> Column:
    """FUN-22: first non-blank text of a French translation from one of three countries."""
    ok = F.filter(translations, lambda t: (t["iso_639_1"] == "fr") & t["iso_3166_1"].isin(FRENCH_TRANSLATIONS) & (strip(F.coalesce(t["data"][field], F.lit(""))) != ""))
    return F.try_element_at(F.transform(ok, lambda t: strip(t["data"][field])), F.lit(1))


def regional_titles(titles: Column) -> Column:
    """FUN-23: distinct titles of five francophone countries, in their order."""
    ok = F.filter(titles, lambda t: t["iso_3166_1"].isin(FRENCH_TITLES) & (strip(F.coalesce(t["title"], F.lit(""))) != ""))
    return F.coalesce(F.array_distinct(F.transform(ok, lambda t: strip(t["title"]))), F.array().cast("array<string>"))


def crew_of(crew: Column, jobs: list[str]) -> Column:
    """FUN-24: names with their place among the members of a role."""
    kept = F.filter(crew, lambda m: m["job"].isin(jobs))
    return F.transform(kept, lambda m, i: F.struct(i.alias("display_order"), clean_string(m["name"]).alias("name"), m["job"].alias("job")))


def top_cast(cast: Column, n: int = 10) -> Column:
    """FUN-24: the first n by billing; a missing place counts as 999, ties keep their order."""
    placed = F.transform(cast, lambda m, i: F.struct(F.coalesce(m["order"], F.lit(999)).alias("o"), i.alias("i"), clean_string(m["name"]).alias("name")))
    return F.slice(F.transform(F.array_sort(placed), lambda m: m["name"]), 1, n)


def content_hash(c: Column) -> Column:
    """FUN-33: MD5 of the UTF-8 bytes."""
    return F.md5(F.encode(c, "UTF-8"))


def fold_accents(c: Column) -> Column:
    """FUN-35: accents off, runs of white space to one space, stripped."""
    return strip(F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"(?U)\s+", " "))


def looks_french(c: Column, terms: list[str], stopwords: list[str]) -> Column:
    """FUN-36: a diacritic, a domain term, or two stopwords (each occurrence counts)."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1))
    hits = F.size(F.filter(words, lambda w: w.isin(stopwords)))
    term = F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(c), t))
    return F.coalesce(c.rlike("[àâäçéèêëîïôöùûüÿœ]") | term | (hits >= 2), F.lit(False))


def language_gate(text: Column, lang: Column, confidence: Column, least: float = 0.7) -> Column:
    """FUN-37: a detector's fr or en where a text has two words or more and the confidence is at least `least`, else mixed."""
    words = F.size(F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != ""))
    return F.when((words >= 2) & (confidence >= least) & lang.isin("fr", "en"), lang).otherwise(F.lit("mixed"))


def strip_noise(c: Column) -> Column:
    """FUN-38: words of two letters or more that are not noise; the query itself where none is left."""
    words = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1)), lambda w: (F.length(w) > 1) & ~w.isin(NOISE_WORDS))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(c)


def expand_query(c: Column, keywords: list[str], suffix: str) -> Column:
    """FUN-39: a suffix where no domain word occurs."""
    known = F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(c), k))
    return F.when(known, c).otherwise(F.concat_ws(" ", c, F.lit(suffix)))


def redact(event: Column, keys: list[str], mask: str = "[REDACTED]") -> Column:
    """FUN-40: values of sensitive keys (any case) masked."""
    return F.transform_values(event, lambda k, v: F.when(F.lower(k).isin(keys), F.lit(mask)).otherwise(v))


def popularity_score(votes: Column, popularity: Column) -> Column:
    """FUN-41: log-damped blend; missing numbers count as 0."""
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return 0.7 * F.log1p(z(votes)) / 10 + 0.3 * F.log1p(z(popularity)) / 6


def weighted_score(parts: list[tuple[Column, Column, float]], cap: float = 10.0, digits: int = 2) -> Column:
    """AGG-12: mean over the components that are present, weights renormalised; none gives 0.

    parts: (present, value, weight). Rounded half up.
    """
    w = sum((F.when(p, F.lit(x)).otherwise(0.0) for p, _, x in parts), F.lit(0.0))
    s = sum((F.when(p, v * x).otherwise(0.0) for p, v, x in parts), F.lit(0.0))
    return F.when(w > 0, F.round(F.least(s / w, F.lit(cap)), digits)).otherwise(F.lit(0.0))


def film_score(vote_average: Column, tomatometer: Column, imdb: Column, kaggle: Column) -> Column:
    """AGG-12 with the four film sources; an average of 0 is absent, a tomatometer of 0 is not."""
    return weighted_score([
        (F.coalesce(vote_average > 0, F.lit(False)), vote_average, 0.25), (tomatometer.isNotNull(), tomatometer / 10, 0.30), (imdb.isNotNull(), imdb, 0.30), (kaggle.isNotNull(), kaggle, 0.15),
    ])


def validate(rules: dict[str, Column]) -> Column:
    """FUN-28: names of the rules that a row breaks; a rule that is null holds."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
