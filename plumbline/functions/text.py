"""Text as column expressions: cleaning, tokens, language, terms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{M}\p{N}_-]+"
#: Masks of dates and decimals, applied to lower-cased text in this order.
MASKS = [(r"\b\d{4}-\d{2}-\d{2}\b", "DATE"), (r"\b\d{2}\.\d{2}\.\d{4}\b", "DATE"), (r"\b(?!(?:19|20)\d{2}\b)\d+\.\d+\b", "NUMBER")]
#: Stop words of the tokenizer, as lemmas.
STOP = (
    "и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то", "все", "она", "так", "его", "но", "да", "ты", "к", "у", "же",
    "вы", "за", "бы", "по", "только", "её", "мне", "быть", "вот", "от", "меня", "ещё", "нет", "о", "из", "ему", "теперь", "когда", "даже",
    "ну", "вдруг", "ли", "если", "уже", "или", "ни", "был", "него", "до", "вас", "нибудь", "опять", "уж", "вам", "ведь", "там", "потом",
    "себя", "ничто", "ей", "мочь", "они", "тут", "где", "есть", "надо", "ней", "для", "мы", "тебя", "их", "чем", "сам", "чтобы", "без",
    "будто", "чего", "раз", "тоже", "под", "будет", "ж", "тогда", "кто", "этот", "тот", "потому", "какой", "совсем", "здесь", "один",
    "почти", "мой", "тем", "сейчас", "куда", "зачем", "весь", "никогда", "можно", "при", "наконец", "два", "об", "другой", "хоть",
    "после", "над", "большой", "через", "наш", "про", "много", "разве", "три", "впрочем", "хороший", "свой", "перед", "иногда",
    "лучше", "чуть", "нельзя", "такой", "более", "всегда", "конечно", "между",
)
#: Stop words of keyword candidates are a parameter; these are for English text.
KEYWORD_STOP = ("the", "and", "of", "to", "in", "is", "for", "on", "with", "as")


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), where value is worked out once, however often make names it."""
    return F.get(F.transform(F.array(value), make), 0)


def running(sizes: Column) -> Column:
    """For each number of an array the sum of those before it. The array is gone through in
    about root-n blocks, as an array that grows element by element is copied every time."""
    zero = F.lit(0).cast("long")

    def summed(block: Column) -> Column:
        """A struct of the sums before each element (at 0) and the sum of all."""
        begin = F.struct(F.array().cast("array<bigint>").alias("before"), zero.alias("at"))
        return F.aggregate(block, begin, lambda a, x: F.struct(F.concat(a["before"], F.array(a["at"])).alias("before"), (a["at"] + x).alias("at")))

    def joined(blocks: Column) -> Column:
        """Of each block the sum of the blocks before it, then of each element."""
        begin = F.struct(F.array().cast("array<struct<base:bigint,before:array<bigint>>>").alias("done"), zero.alias("at"))
        add = lambda a, b: F.struct(F.concat(a["done"], F.array(F.struct(a["at"].alias("base"), b["before"].alias("before")))).alias("done"), (a["at"] + b["at"]).alias("at"))
        done = F.aggregate(blocks, begin, add, lambda a: a["done"])
        return F.flatten(F.transform(done, lambda b: F.transform(b["before"], lambda x: x + b["base"])))

    def cut(s: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(s).cast("double"))).cast("int"))
        starts = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s), width)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: summed(F.slice(s, i, width)))

    return joined(bound(sizes, cut))


def clean(c: Column) -> Column:
    """Without NUL and BOM, with LF ends; lines trimmed, their inner white space single, blank ones dropped."""
    c = F.regexp_replace(F.regexp_replace(c, "[\\x00\\ufeff]", ""), "\r\n?", "\n")
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s ]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def masked(c: Column) -> Column:
    """Lower case, with dates and decimals masked. Texts without a sign between two digits
    have neither, and are not searched three times."""
    low = out = F.lower(c)
    for pattern, name in MASKS:
        out = F.regexp_replace(out, pattern, name)
    return F.when(c.rlike(r"\d[.-]\d"), out).otherwise(low)


def counts(t: Column, stop: tuple[str, ...]) -> Column:
    return (F.length(t) >= 2) & ~t.isin(*stop) & ~t.rlike(r"^\p{Nd}+$")


#: Signs of ASCII are named one by one, which the engine looks up in a table.
_ASCII = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
_T, _PART = rf"[{_ASCII}\p{{L}}\p{{M}}\p{{N}}-]", rf"[{_ASCII}\p{{L}}\p{{M}}\p{{N}}]"
#: Whole runs of two or three signs as they are; longer ones in parts of two signs or more between
#: hyphens. Numbers are passed over.
WORDS = rf"(?<!{_T})(?!\p{{Nd}}+(?!{_T})){_T}{{2,3}}(?!{_T})|(?!\p{{Nd}}+(?!{_PART})){_PART}{{2,}}"


def tokens(c: Column, stop: tuple[str, ...] = STOP, lemma: Callable[[Column], Column] | None = None) -> Column:
    """Lower-cased lemmas without stop words and numbers; hyphenated words in parts.
    lemma: from a word to its lemma; words as they are without it."""
    found = F.regexp_extract_all(masked(c), F.lit(WORDS), F.lit(0))
    if lemma is not None:
        return F.filter(F.transform(found, lemma), lambda t: counts(t, stop))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def token_rows(df: DataFrame, column: str = "text", stop: tuple[str, ...] = STOP, lemma: Callable[[Column], Column] | None = None) -> DataFrame:
    """id and token, a row for each of the same tokens. The filter stands on rows here, where
    the engine compiles it, as a corpus is tokenised once."""
    each = df.select("id", F.explode(F.regexp_extract_all(masked(F.col(column)), F.lit(WORDS), F.lit(0))).alias("token"))
    if lemma is not None:
        return each.select("id", lemma(F.col("token")).alias("token")).where(counts(F.col("token"), stop))
    return each.where(~F.col("token").isin(*stop)) if stop else each


def simple_tokens(c: Column) -> Column:
    """Without a lemmatiser: words between white space of more than two characters."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda t: F.length(t) > 2)


def language(c: Column) -> Column:
    """ru if more than 0.3 of the letters are Cyrillic, else en."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(F.regexp_count(c, F.lit(r"[Ѐ-ӿ]")) > 0.3 * letters, "ru").otherwise("en")


def crude_language(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7F]"), "ru").otherwise("en")


#: How a query is introduced to the embedding model.
PREFIX = {
    "ru": "Инструкция: Найди релевантную информацию в документах\nЗапрос: ",
    "en": "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: ",
}


def prefixed(c: Column) -> Column:
    return F.concat(F.when(language(c) == "ru", PREFIX["ru"]).otherwise(PREFIX["en"]), c)


#: Families of technical terms, case-insensitive.
FAMILIES = [
    r"\b(?:Python|JavaScript|TypeScript|Java|C\+\+|C#|PHP|Ruby|Go|Rust|Swift|Kotlin|SQL)\b",
    r"\b(?:React|Vue|Angular|Django|Flask|Express|Spring|Laravel|Rails|ASP\.NET|FastAPI|Celery)\b",
    r"\b(?:PostgreSQL|MySQL|MongoDB|Redis|SQLite|Oracle|SQL Server|ChromaDB|Elasticsearch|Prisma)\b",
    r"\b(?:Docker|Kubernetes|AWS|Azure|GCP|API|REST|GraphQL|JWT|OAuth|SSL|TLS|RAG|LLM|AI|ML)\b",
    r"\b\w+\.(?:pdf|docx?|xlsx?|pptx?|csv|json|xml|html|css|js|ts|py|java|cpp|sql|md|txt)\b",
    r"\b(?:HTTP|HTTPS|FTP|SMTP|TCP|UDP|WebSocket|SSE)\b",
    r"\b\d+(?:\.\d+)?\s*(?:MB|GB|TB|KB|ms|sec|min|hour|%|px|em|rem)\b",
    r"\bv?\d+\.\d+(?:\.\d+)?(?:-\w+)?\b",
    r"\b(?:embedding|vector|neural|model|algorithm|dataset|transformer|BERT|GPT|LLM|NLP|RAG)\b",
    r"\b(?:SaaS|B2B|B2C|MVP|ROI|KPI|CRM|ERP|UI|UX|API)\b",
    r"\b(?:server|client|backend|frontend|database|cache|queue|worker|service|middleware)\b",
]
#: Calls and CamelCase, case-sensitive.
SHAPES = [r"\b\w+\(\)", r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b"]
MOST_TERMS = 10


def sooner(pattern: str) -> str:
    """A pattern that finds the same in less time. Of words, the next sign is looked up among all
    that one may begin with, before borders and words are tried; a run of word signs that a sign
    of another kind has to follow is not given back."""
    if pattern.startswith(r"\b(?:"):
        first = {w[0] for w in pattern[5:].split("|")}
        return f"(?=[{''.join(sorted({c for w in first for c in (w.lower(), w.upper())}))}]){pattern}"
    return r"\b\w++" + pattern[5:] if pattern.startswith((r"\b\w+\.", r"\b\w+\(")) else pattern


def technical_terms(c: Column) -> Column:
    """The first MOST_TERMS terms by name: known ones lower-cased unless short and upper case, and shapes as they are."""
    named = F.concat(*(F.regexp_extract_all(c, F.lit("(?i)" + sooner(p)), F.lit(0)) for p in FAMILIES))
    named = F.transform(named, lambda t: F.when((t == F.upper(t)) & t.rlike(r"\p{Lu}") & (F.length(t) <= 5), t).otherwise(F.lower(t)))
    shaped = F.concat(*(F.regexp_extract_all(c, F.lit(sooner(p)), F.lit(0)) for p in SHAPES))
    underscores = lambda t: F.length(t) - F.length(F.replace(t, F.lit("_"), F.lit("")))
    shaped = F.filter(shaped, lambda t: underscores(t) <= 1)
    kept = F.filter(
        F.array_distinct(F.concat(named, shaped)),
        lambda t: (F.length(t) >= 3) & ~t.rlike(r"^[_\-.]+$") & ~t.rlike(r"^[\d.]+$") & (underscores(t) < F.floor(F.length(t) / 2)),
    )
    return F.slice(F.array_sort(kept), 1, MOST_TERMS)


def keep_keyword(word: Column, score: Column, stop: tuple[str, ...] = KEYWORD_STOP) -> Column:
    """The filter on semantic keyword candidates."""
    return (
        (F.length(word) >= 3) & (score > 0.3) & ~F.lower(word).isin(*stop) & ~word.rlike("^[0-9]")
        & ~F.contains(word, F.lit("___")) & (F.size(F.split(word, " ")) <= 2)
    )


def has_dates(c: Column) -> Column:
    months = "января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря"
    return c.rlike(rf"\b\d{{1,2}}\.\d{{1,2}}\.\d{{4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b|\d{{1,2}} (?:{months})")


def clean_answer(c: Column) -> Column:
    """Without control marks, role prefix and greeting; too short an answer becomes an apology."""
    c = F.regexp_replace(c, r"<\|[^|]*\|>", "")
    c = F.regexp_replace(c, r"^(?i)\s*(assistant|user|system)\s*:\s*", "")
    c = F.trim(F.regexp_replace(c, r"^(?iu)\s*(hello|hi|здравствуйте|привет)[!,.]?\s*", ""))
    return F.when(F.length(c) < 10, "Извините, не удалось сформировать ответ.").otherwise(c)


def session_title(c: Column) -> Column:
    return F.when(F.length(c) > 50, F.concat(F.substring(c, 1, 50), F.lit("..."))).otherwise(c)


def history_line(role: Column, c: Column) -> Column:
    return F.when(role == "assistant", F.concat(F.lit("[Ответил про: "), F.substring(c, 1, 200), F.lit("...]"))).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def cache_key(prefix: str, query: Column, level: Column, params: Column) -> Column:
    """Equal for queries that differ in case and outer white space only."""
    return F.concat(F.lit(prefix), F.md5(F.concat_ws("|", F.lower(F.trim(query)), level.cast("string"), params)))


#: The parts of a prompt, round the history, the context and the question.
PROMPT = (
    """Отвечай только финальным содержательным ответом. Без приветствий, предисловий, дисклеймеров и рассуждений. Никаких служебных меток.

Ты корпоративный RAG-ассистент. Используй ТОЛЬКО русский язык.

ПРАВИЛА:
- Используй ТОЛЬКО факты из КОНТЕКСТА ниже
- Если ответа нет в контексте: "Нет информации в предоставленном контексте"
- Сохраняй точные номера пунктов и статей
- Отвечай лаконично и профессионально

""",
    """

КОНТЕКСТ:
""",
    """

ВОПРОС: """,
    """

ОТВЕТ:""",
)


def prompt(question: Column, context: Column, history: Column) -> Column:
    """history: an array of structs with role and text, oldest first."""
    line = lambda m: F.concat(F.when(m["role"] == "user", "Вопрос").otherwise("Ответ"), F.lit(": "), history_line(m["role"], m["text"]), F.lit("\n"))
    before = F.when(F.size(history) > 0, F.concat(F.lit("\n\nПредыдущие сообщения:\n"), F.array_join(F.transform(history, line), ""))).otherwise("")
    return F.concat(F.lit(PROMPT[0]), before, F.lit(PROMPT[1]), context, F.lit(PROMPT[2]), question, F.lit(PROMPT[3]))


def token_rate(c: Column, seconds: Column) -> Column:
    """Tokens of a group of texts for each second."""
    return F.round(F.sum(token_estimate(c)) / F.sum(seconds), 6)


def json_object(answer: Column, schema: str) -> Column:
    """The first JSON object in a model's answer."""
    return F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), schema)


def request_type(answer: Column) -> Column:
    """CALENDAR, RAG or SIMPLE with its confidence; what cannot be read is RAG at 0.3, other types RAG at 0.5."""
    found = json_object(answer, "type string, confidence double")
    kind = F.upper(found["type"])
    known = kind.isin("CALENDAR", "RAG", "SIMPLE")
    score = F.when(found.isNull() | found["type"].isNull(), 0.3).when(known, F.coalesce(found["confidence"], F.lit(0.8))).otherwise(0.5)
    return F.struct(F.when(known, kind).otherwise("RAG").alias("type"), score.alias("confidence"))


def employees(answer: Column) -> Column:
    """Rows of a JSON array whose e-mail has an @."""
    found = F.from_json(F.regexp_extract(answer, r"(?s)\[.*\]", 0), "array<struct<name:string,email:string,position:string>>")
    return F.filter(found, lambda e: F.contains(e["email"], F.lit("@")))


#: Capitalised words that begin a request.
NO_NAMES = ("Дай", "Можешь", "Поставь", "Встреча", "Система", "Почту")


#: Letters that begin and continue a name.
CYRILLIC, LATIN = ("А-ЯЁ", "а-яё"), ("A-Z", "a-z")


def people(c: Column, letters: tuple[str, str] = CYRILLIC, words: int = 3) -> Column:
    """Capitalised names of so many words at most, each once, in order."""
    one = "[{}][{}]+".format(*letters)
    found = F.regexp_extract_all(c, F.lit(rf"(?<!\p{{L}}){one}(?: {one}){{0,{words - 1}}}(?!\p{{L}})"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda n: (F.length(n) > 2) & ~n.isin(*NO_NAMES)))


def any_of(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(p.lower())) for p in parts))
