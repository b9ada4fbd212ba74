"""Rule-first routing of questions (CLS-01..04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that show a question about the film domain.
DOMAIN = [
    "horreur", "horror", "scary", "effrayant", "terrifiant", "zombie", "vampire", "ghost", "fantome", "fantôme", "slasher", "gore", "surnaturel", "supernatural", "demon", "démon", "exorcis", "hante", "hanté", "haunted", "creature", "créature", "monstre", "monster", "sang", "blood", "mort", "dead", "tueur", "killer", "psychopathe", "cauchemar", "nightmare", "possession", "maudit", "cursed", "film", "movie", "cinema", "cinéma", "réalisateur", "realisateur",
]
# Greetings, farewells and thanks.
GREETINGS = ["bonjour", "salut", "hello", "hey", "coucou", "bonsoir", "hi", "au revoir", "bye", "goodbye", "adieu", "bonne nuit", "merci", "thanks", "thank you", "good morning", "good evening", "à bientôt", "bientot", "prochaine", "bye bye"]
THANKS = ["merci", "thanks", "thank you"]
FALLBACK = "needs_database"


def has_domain(text: Column) -> Column:
    return F.exists(F.array(*map(F.lit, DOMAIN)), lambda k: F.contains(F.lower(text), k))


def _any_phrase(text: Column, phrases: list[str]) -> Column:
    """Whether one to three neighbouring words of a text are a phrase."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))
    run = lambda n: F.transform(w, lambda x, i: F.concat_ws(" ", F.slice(w, i + 1, n)))
    runs = [w, run(2), run(3)]
    return F.exists(F.concat(*runs), lambda x: x.isin(phrases))


def rule_intent(text: Column, most_words: int = 10) -> Column:
    """CLS-01: blank, thanks and short greetings without a domain word; null is left to the model."""
    short = (F.size(F.split(F.trim(text), r"\s+")) <= most_words) & ~has_domain(text)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", FALLBACK).when(_any_phrase(text, THANKS) & short, "thanks").when(_any_phrase(text, GREETINGS) & short, "conversational")


def model_intent(text: Column, scores: Column, threshold: float = 0.4) -> Column:
    """CLS-02: the best label of a map label -> score; domain words and low confidence lead to the fallback."""
    top = F.array_max(F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("score"), e["key"].alias("label"))))
    return F.when(top["score"] < threshold, FALLBACK).when(top["label"].isin("off_topic", "conversational") & has_domain(text), FALLBACK).otherwise(F.coalesce(top["label"], F.lit(FALLBACK)))


def route(intent: Column) -> Column:
    """CLS-03."""
    return F.when(intent == FALLBACK, "retrieval").when(intent == "off_topic", "refusal").otherwise("template")


def split_routes(routed: DataFrame) -> dict[str, DataFrame]:
    """CLS-03: the rows of each route; together they are all rows."""
    return {r: routed.where(F.col("route") == r) for r in ("retrieval", "refusal", "template")}


# Words of a farewell.
FAREWELLS = ["au revoir", "bye", "goodbye", "adieu", "a bientot", "bonne nuit", "merci", "thanks"]


def template(intent: Column, text: Column, replies: dict[str, str]) -> Column:
    """CLS-04: the reply for an intent; a conversational one gets "farewell" where the text holds a word of farewell.

    An intent without a reply, as one that needs retrieval, gives null.
    """
    leaves = (intent == "conversational") & F.exists(F.array(*map(F.lit, FAREWELLS)), lambda k: F.contains(F.lower(F.coalesce(text, F.lit(""))), k))
    table = F.create_map(*[F.lit(x) for kv in replies.items() for x in kv])
    return F.try_element_at(table, F.when(leaves, "farewell").otherwise(intent))


def classify(df: DataFrame, text: str, scores: Column | None = None) -> DataFrame:
    """(…, intent, route) by rules, then by the model's scores where there are any."""
    t = F.col(text)
    rest = F.lit(FALLBACK) if scores is None else model_intent(t, scores)
    intent = F.coalesce(rule_intent(t), rest)
    return df.withColumn("intent", intent).withColumn("route", route(F.col("intent")))
