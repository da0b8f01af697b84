"""A quick guess of a text's language from letter trigrams and common words, as a default for recognition."""

from __future__ import annotations

from collections import Counter
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.batches import map_batches

# The languages with their names, and common words from which their trigrams are made.
LANGUAGES = {"eng": "English", "fra": "French", "deu": "German", "spa": "Spanish", "ita": "Italian", "nld": "Dutch", "por": "Portuguese"}
_WORDS = {
    "eng": "the of and to in is that it was for on are with as be at by this have from or had not but which been were their has there will would they when more can said other than time into only new about after also some these two may then first any like now such",
    "fra": "le la les de des du un une et est que qui dans pour par sur au avec ne pas plus ce cette ces son sa ses été être ou mais sans sous elle nous vous ils leur tout comme aussi fait peut bien deux même entre depuis encore avoir toujours très",
    "deu": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man dann soll wenn",
    "spa": "el la los las de del un una y en es que se no por con su para como más pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno ni contra otros ese eso ante ellos son fue ser tiene",
    "ita": "il lo la i gli le di del della dei un una e in che non per con si da su come più ma anche o al alla nel nella sono ha questo questa perché quando senza prima dopo ogni tra essere stato era suo sua loro molto tutto cosa fare ancora delle degli",
    "nld": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij uit door naar nog wel heeft werd wordt deze dit die of tot zonder over kan zo meer haar hij ze wij hun onder tegen al andere moet veel worden geen",
    "por": "o a os as de do da dos das um uma e em no na que é se não por com para como mais mas ao à foi são ou seu sua este esta também já até sem antes depois porque ele ela isso muito quando nos tem pela pelo entre era ser há",
}
#: A shorter text gets the default language; confidence rises with length and with the lead over the next.
LEAST, LONG = 80, 240
#: What the share of common words weighs against the mean frequency of trigrams.
WORD_WEIGHT = 0.002


def _trigrams(text: str) -> Counter:
    t = f" {text} "
    return Counter(t[i : i + 3] for i in range(len(t) - 2))


@cache
def _profiles() -> dict[str, dict[str, float]]:
    out = {}
    for code, words in _WORDS.items():
        n = Counter()
        for w in words.split():
            n += _trigrams(w)
        total = sum(n.values())
        out[code] = {g: c / total for g, c in n.items()}
    return out


@cache
def _common() -> dict[str, frozenset[str]]:
    return {code: frozenset(words.split()) for code, words in _WORDS.items()}


def clean(c):
    """Letters and blanks only, without code and addresses."""
    c = F.regexp_replace(c, r"```[\s\S]*?```", " ")
    c = F.regexp_replace(c, r"https?://\S+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\s]", " "), r"\s+", " "))


def guess(text: str) -> tuple[str, str, bool]:
    """(code, confidence, detected) of a cleaned text."""
    if len(text) < LEAST:
        return "eng", "low", False
    low = text.lower()
    seen, words = _trigrams(low), low.split()
    total = sum(seen.values())
    # Common words count beside trigrams, which alone take long Latin words for another language.
    score = sorted(
        ((sum(p.get(g, 0.0) * c for g, c in seen.items()) / total + WORD_WEIGHT * sum(map(_common()[code].__contains__, words)) / len(words), code) for code, p in _profiles().items()), reverse=True
    )
    (best, code), (second, _) = score[:2]
    if not best:
        return "eng", "low", False
    lead = (best - second) / best
    return code, "high" if len(text) >= LONG and lead > 0.08 else "medium" if lead > 0.03 else "low", True


def detect(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, code, label, confidence, detected) of each document; short and null texts are English by default."""
    src = df.select(F.col(id_col).alias("doc_id"), clean(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))

    def one(r):
        code, confidence, detected = guess(r["t"])
        yield r["doc_id"], code, LANGUAGES[code], confidence, detected

    schema = T.StructType([src.schema["doc_id"], *[T.StructField(n, T.StringType()) for n in ("code", "label", "confidence")], T.StructField("detected", T.BooleanType())])
    return map_batches(src, one, schema)
