"""What a model has to offer, the rules that stand in for it, and the registry by name.

A port maps columns to columns, so that a served model (an Arrow UDF) and a rule (an expression) are used alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweft.functions.text import jaccard, plain_words

#: Frequent words of each language, for voting.
STOP_WORDS = {
    "en": "the of and to in a is that for was with as by on from", "de": "der die das und in den von zu mit ist des auf für im nicht",
    "fr": "le la les de des et en un une du dans que pour est à", "es": "el la los las de y en un una que por con del para es",
    "it": "il la di che e un una per del della in con non le è", "nl": "de het een van en in is dat op te voor met zijn niet aan",
}
NEGATIONS = "not no never none kein keine nicht nie pas jamais aucun sin nunca ningún ninguna non mai nessuno niet geen nooit".split()


def language_votes(text: Column) -> Column:
    """Struct (lang, votes, confidence): the language whose frequent words occur most; null under a confidence of 0.5.

    The first 1,000 characters decide, as a detector's input does."""
    words = F.concat(F.lit(" "), plain_words(F.left(text, F.lit(1000))), F.lit(" "))

    def votes_for(stops: list[str]) -> Column:
        return F.regexp_count(words, F.lit(f"(?<= )(?:{'|'.join(stops)})(?= )"))

    votes = [F.struct(votes_for(s.split()).alias("votes"), F.lit(lang).alias("lang")) for lang, s in STOP_WORDS.items()]
    def decided(ranked: Column) -> Column:
        first, second = ranked[0], ranked[1]
        confidence = F.when(first["votes"] > 0, first["votes"] / (first["votes"] + second["votes"]))
        return F.struct(F.when(confidence > 0.5, first["lang"]).alias("lang"), first["votes"].alias("votes"), F.round(confidence, 6).alias("confidence"))

    # The ranking is bound to a variable, so that it is worked out once and not at each mention.
    return F.transform(F.array(F.sort_array(F.array(*votes), asc=False)), decided)[0]


def _content(text: Column) -> Column:
    stop = sorted({w for s in STOP_WORDS.values() for w in s.split()})
    return F.filter(F.array_distinct(F.split(plain_words(text), " ")), lambda w: ~w.isin(stop) & (w != ""))


def _negative(text: Column) -> Column:
    return F.size(F.array_intersect(F.split(plain_words(text), " "), F.array(*map(F.lit, NEGATIONS)))) % 2 == 1


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("\\d+(?:[.,]\\d+)*"), F.lit(0)))


def alignment_score(claim: Column, source: Column) -> Column:
    """-1 to 1: the overlap of content words; its sign falls where one side is negated or the numbers differ."""
    overlap = jaccard(_content(claim), _content(source))
    differ = (F.size(numbers(claim)) > 0) & (F.size(numbers(source)) > 0) & (F.size(F.array_intersect(numbers(claim), numbers(source))) == 0)
    return F.round(F.when((_negative(claim) != _negative(source)) | differ, -overlap).otherwise(overlap), 6)


def query_terms(text: Column, n: int = 6) -> Column:
    """The longest content words in order of occurrence, as a search query."""
    words = _content(text)
    longest = F.slice(F.transform(F.sort_array(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")))), lambda s: s["w"]), 1, n)
    return F.array_join(F.filter(words, lambda w: F.array_contains(longest, w)), " ")


def lead_sentence(text: Column) -> Column:
    return F.regexp_extract(text, "^([\\s\\S]*?[.!?…][”»“\"’)]*)(?:\\s|$)", 1)


def complete_sentences(text: Column) -> Column:
    """Sentences that hold a verb and a noun or pronoun, by their endings and frequent words."""
    verb = "(?i)\\b(is|are|was|were|has|had|ist|sind|war|hat|hatte|est|sont|a|ont|es|son|fue|era|ha|hanno|heeft|zijn|werd)\\b|\\p{L}{3,}(ed|te|ten|é|ó|ò|de|den)\\b"
    noun = "\\b\\p{Lu}\\p{L}+|(?i)\\b(it|he|she|they|we|you|er|sie|es|wir|il|elle|ils|él|ella|lei|lui|hij|zij|wij)\\b"
    return F.filter(F.split(text, "(?<=[.!?…])\\s+"), lambda s: s.rlike(verb) & s.rlike(noun))


def is_grammatical(text: Column) -> Column:
    return (F.length(F.trim(text)) >= 20) & (F.size(complete_sentences(text)) >= 2)


def accepted_claims(candidates: DataFrame, key: str, text: str = "text", pos: str = "pos", n: int = 5) -> DataFrame:
    """Candidates with text, the first ``n`` of each key, numbered c1, c2, ..."""
    from claimweft.operators.search import top_per_key

    kept = candidates.withColumn(text, F.trim(text)).filter(F.col(text) != "")
    return top_per_key(kept, [key], n, F.asc(pos), rank="_n").withColumn("claim_id", F.concat(F.lit("c"), F.col("_n").cast("string"))).drop("_n")


def chat_messages(system: Column | None, user: Column) -> Column:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(*([turn("system", system)] if system is not None else []), turn("user", user))


def prompt(task: str, parts: dict[str, Column]) -> Column:
    """A task line, then each part that isn't null under its name."""
    return F.concat_ws("\n", F.lit(task), *[F.concat(F.lit(f"{name}: "), c) for name, c in parts.items()])


PORTS: dict[str, dict[str, Callable]] = {
    "detect_language": {"votes": language_votes}, "compare": {"overlap": alignment_score}, "query": {"terms": query_terms}, "summarise": {"lead": lead_sentence},
}


def port(task: str, name: str, registry: dict[str, dict[str, Callable]] = PORTS) -> Callable:
    try:
        return registry[task][name]
    except KeyError:
        raise ValueError(f"no implementation {name!r} of {task!r}; there are {sorted(registry.get(task, {}))}") from None


def register(task: str, name: str, function: Callable) -> None:
    PORTS.setdefault(task, {})[name] = function
