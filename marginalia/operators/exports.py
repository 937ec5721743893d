"""Flashcards and citations as text formats: one row a card or item, joined by the writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import cloze_terms, simple_sentences
from marginalia.operators.places import with_places

#: Citation types in each format.
RIS = {"journalArticle": "JOUR", "book": "BOOK", "bookSection": "CHAP", "conferencePaper": "CONF", "thesis": "THES", "report": "RPRT", "webpage": "ELEC", "preprint": "UNPB"}
BIBTEX = {"journalArticle": "article", "book": "book", "bookSection": "incollection", "conferencePaper": "inproceedings", "thesis": "phdthesis", "report": "techreport", "webpage": "misc", "preprint": "unpublished"}
CSL = {"journalArticle": "article-journal", "book": "book", "bookSection": "chapter", "conferencePaper": "paper-conference", "thesis": "thesis", "report": "report", "webpage": "webpage", "preprint": "article"}


def _kind(table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("item_type")), F.lit(other))


def _lines(*lines: Column) -> Column:
    """The lines that aren't null."""
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def _given(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


# Cards: question, answer, hint, source, tags (array)


def anki_fields(cards: DataFrame) -> DataFrame:
    """front, back and tags of the semicolon-parted format; write with ``quoteAll``."""
    front = F.concat("question", F.when(_given("hint"), F.concat(F.lit("\n\n<i>Hint: "), "hint", F.lit("</i>"))).otherwise(""))
    back = F.concat("answer", F.when(_given("source"), F.concat(F.lit("\n\n<small>Source: "), "source", F.lit("</small>"))).otherwise(""))
    return cards.select("card_id", front.alias("front"), back.alias("back"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ").alias("tags"))


def write_anki_csv(cards: DataFrame, path: str) -> None:
    anki_fields(cards).select("front", "back", "tags").write.mode("overwrite").option("sep", ";").option("quoteAll", True).csv(path)


def anki_text(cards: DataFrame) -> DataFrame:
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", ")))
    return cards.select("card_id", _lines(F.concat(F.lit("Q: "), "question"), F.concat(F.lit("A: "), "answer"), tags, F.lit("")).alias("entry"))


def card_json(cards: DataFrame) -> DataFrame:
    return cards.select("card_id", F.to_json(F.struct("question", "answer", "hint", "source", "tags")).alias("entry"))


def deck(cards: DataFrame, name: str, by: str) -> DataFrame:
    """One JSON deck for each value of ``by``."""
    c = F.sort_array(F.collect_list(F.struct("card_id", "question", "answer", "tags")))
    return cards.groupBy(by).agg(F.to_json(F.struct(F.lit(name).alias("deck_name"), F.count("*").alias("count"), c.alias("cards"))).alias("deck"))


def spaced_markdown(cards: DataFrame) -> DataFrame:
    tags = F.when(F.size("tags") > 0, F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), F.replace(t, F.lit(" "), F.lit("-")))), " "))
    return cards.select("card_id", _lines(F.lit("#flashcard"), F.concat("question", F.lit("\n?\n"), "answer"), tags, F.lit("")).alias("entry"))


def callouts(cards: DataFrame) -> DataFrame:
    """A folded callout a card; every line of the answer is quoted."""
    hint = F.when(_given("hint"), F.concat(F.lit("> *Hint: "), "hint", F.lit("*\n>")))
    source = F.when(_given("source"), F.concat(F.lit(">\n> *Source: "), "source", F.lit("*")))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(">\n> Tags: "), F.array_join("tags", ", ")))
    answer = F.regexp_replace("answer", "(?m)^", "> ")
    return cards.select("card_id", _lines(F.concat(F.lit("> [!question]- "), "question"), hint, answer, source, tags, F.lit("")).alias("entry"))


def table_rows(cards: DataFrame) -> DataFrame:
    """Markdown table rows: pipes escaped, lines joined, 100 characters at most."""
    cell = lambda c: F.replace(F.replace(F.col(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    cut = lambda x: F.when(F.length(x) > 100, F.concat(F.substring(x, 1, 97), F.lit("..."))).otherwise(x)
    return cards.select("card_id", F.concat(F.lit("| "), cut(cell("question")), F.lit(" | "), cut(cell("answer")), F.lit(" | "), F.array_join("tags", ", "), F.lit(" |")).alias("entry"))


FORMATS = {"anki_txt": anki_text, "json": card_json, "spaced_markdown": spaced_markdown, "callouts": callouts, "table": table_rows}


def scheduler_json(states: DataFrame, key: str = "card_id") -> DataFrame:
    """A JSON line {card: state} for each card, as ``readers.scheduler_states`` reads them."""
    rest = F.struct(*(c for c in states.columns if c != key))
    return states.select(key, F.to_json(F.create_map(F.col(key), rest)).alias("entry"))


def write_all(cards: DataFrame, path: str) -> None:
    """One folder a format, and a README that names them with the number of cards."""
    spark = cards.sparkSession
    lines = [f"{cards.count()} cards", "anki_csv: front, back and tags", *(f"{name}: a card an entry" for name in FORMATS)]
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/README")
    write_anki_csv(cards, f"{path}/anki_csv")
    for name, f in FORMATS.items():
        f(cards).orderBy("card_id").select("entry").write.mode("overwrite").text(f"{path}/{name}")


def fallback_cards(docs: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cards from sentences of more than 30 characters: the first quoted or capitalised term is blanked out, or the
    sentence is asked about."""
    long = F.slice(F.filter(simple_sentences(F.col(text_col)), lambda s: F.length(s) > 30), 1, most)
    s = docs.select(id_col, F.posexplode(long).alias("place", "sentence"))
    m = F.regexp_extract("sentence", r'"([^"]+)"|([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)', 0)
    term = F.when(m.startswith('"'), F.substring(m, F.lit(2), F.length(m) - 2)).otherwise(m)
    s = s.withColumn("term", term)
    has = F.col("term") != ""
    asked = F.concat(F.lit("What does this statement describe? '"), F.substring("sentence", 1, 100), F.lit("...'"))
    return s.select(
        id_col, "place", F.when(has, F.replace(F.col("sentence"), F.col("term"), F.lit("_____"))).otherwise(asked).alias("question"),
        F.when(has, F.col("term")).otherwise(F.col("sentence")).alias("answer"), F.when(has, "recall").otherwise("concept").alias("kind"),
    )


def cloze_cards(docs: DataFrame, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first ``most`` terms, each hidden once in the first sentence that holds it."""
    t = docs.select(id_col, F.split(text_col, "[.!?]+").alias("parts"), F.posexplode(F.slice(cloze_terms(F.col(text_col)), 1, most)).alias("place", "term"))
    first = F.try_element_at(F.filter("parts", lambda s: F.lower(s).contains(F.lower(F.col("term")))), F.lit(1))
    t = t.withColumn("sentence", first).where("sentence is not null")
    at = F.instr(F.lower("sentence"), F.lower("term"))
    hidden = F.concat(F.substring("sentence", F.lit(1), at - 1), F.lit("{{c1::"), "term", F.lit("}}"), F.substring("sentence", at + F.length("term"), F.length("sentence")))
    return t.select(id_col, "place", F.trim(hidden).alias("cloze"), F.col("term").alias("answer"))


# Citations: item_id, item_type, title, authors (array of last, first), date, journal, volume, issue, pages, doi, url, publisher, abstract, tags


def _author(a: Column) -> Column:
    return F.when(a["first"] != "", F.concat(a["last"], F.lit(", "), a["first"])).otherwise(a["last"])


def _names() -> Column:
    return F.transform(F.filter("authors", lambda a: a["last"] != ""), _author)


def ris(items: DataFrame) -> DataFrame:
    line = lambda tag, c: F.when(_given(c), F.concat(F.lit(f"{tag}  - "), F.col(c)))
    each = lambda tag, xs: F.when(F.size(xs) > 0, F.array_join(F.transform(xs, lambda x: F.concat(F.lit(f"{tag}  - "), x)), "\n"))
    ranged = F.col("pages").contains("-")
    pages = F.when(_given("pages") & ranged, F.concat(F.lit("SP  - "), F.trim(F.split_part("pages", F.lit("-"), F.lit(1))), F.lit("\nEP  - "), F.trim(F.regexp_replace("pages", "^[^-]*-", "")))).when(_given("pages"), F.concat(F.lit("SP  - "), "pages"))
    return items.select("item_id", _lines(
        F.concat(F.lit("TY  - "), _kind(RIS, "GEN")), F.concat(F.lit("TI  - "), "title"), each("AU", _names()), line("AB", "abstract"),
        F.when(_given("date"), F.concat(F.lit("PY  - "), F.substring("date", 1, 4), F.lit("\nDA  - "), "date")),
        F.when(_given("journal"), F.concat(F.lit("JO  - "), "journal", F.lit("\nT2  - "), "journal")), line("VL", "volume"), line("IS", "issue"), pages,
        line("DO", "doi"), line("UR", "url"), line("PB", "publisher"), each("KW", F.col("tags")), F.lit("ER  - "),
    ).alias("entry"))


def bibtex(items: DataFrame, order: str = "item_id") -> DataFrame:
    """Entries with keys of the first author's name, the year and the item's place (from 0) among all of them in ``order``."""
    it = with_places(items, order, name="_i")
    field = lambda k, c: F.when(_given(c), F.concat(F.lit(f"  {k} = {{"), F.col(c), F.lit("},")))
    kind = _kind(BIBTEX, "misc")
    last = F.coalesce(F.try_element_at("authors", F.lit(1))["last"], F.lit("Unknown"))
    key = F.concat(F.lower(last), F.when(_given("date"), F.substring("date", 1, 4)).otherwise("nd"), F.lit("_"), F.col("_i"))
    where = F.when(_given("journal"), F.concat(F.when(kind == "article", "  journal = {").otherwise("  booktitle = {"), F.col("journal"), F.lit("},")))
    abstract = F.when(_given("abstract"), F.concat(F.lit("  abstract = {"), F.replace(F.replace(F.col("abstract"), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}")), F.lit("},")))
    names = F.when(F.size("authors") > 0, F.concat(F.lit("  author = {"), F.array_join(_names(), " and "), F.lit("},")))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("  keywords = {"), F.array_join("tags", ", "), F.lit("},")))
    return it.select("item_id", _lines(
        F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",")), F.concat(F.lit("  title = {"), "title", F.lit("},")), names,
        F.when(_given("date"), F.concat(F.lit("  year = {"), F.substring("date", 1, 4), F.lit("},"))), where, field("volume", "volume"), field("number", "issue"),
        field("pages", "pages"), field("doi", "doi"), field("url", "url"), field("publisher", "publisher"), abstract, tags, F.lit("}"),
    ).alias("entry"))


def csl_json(items: DataFrame) -> DataFrame:
    authors = F.transform("authors", lambda a: F.struct(a["last"].alias("family"), a["first"].alias("given")))
    parts = F.filter(F.transform(F.split("date", "-"), lambda p: F.when(p.rlike("^[0-9]+$"), p.try_cast("int"))), lambda p: p.isNotNull())
    issued = F.when(_given("date"), F.struct(F.array(parts).alias("date-parts")))
    return items.select("item_id", F.to_json(F.struct(
        F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("id"), _kind(CSL, "document").alias("type"), F.col("title"), authors.alias("author"),
        issued.alias("issued"), F.col("journal").alias("container-title"), F.col("volume"), F.col("issue"), F.col("pages").alias("page"), F.col("doi").alias("DOI"), F.col("url").alias("URL"),
    )).alias("entry"))


def user_export(users: DataFrame, *parts: tuple[str, DataFrame], key: str = "user_id") -> DataFrame:
    """One JSON a user with that user's rows of each table."""
    out = users.select(key).distinct()
    for name, df in parts:
        rest = [c for c in df.columns if c != key]
        out = out.join(df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name)), key, "left")
    return out.select(key, F.to_json(F.struct(*(n for n, _ in parts))).alias("export"))


#: Citation formats by name.
CITATIONS = {"ris": ris, "bibtex": bibtex, "csl": csl_json}


def citations(items: DataFrame, fmt: str) -> DataFrame:
    """Entries of the items in the format of that name, whatever its case; an unknown one is refused."""
    if fmt.lower() not in CITATIONS:
        raise ValueError(f"{fmt} is none of {', '.join(CITATIONS)}")
    return CITATIONS[fmt.lower()](items)
