"""Extraction from a table of pages: heads, links, table rows, and headers carried down to the rows below them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.functions import rules

COUNTS = ("a_favor", "en_contra", "abstencion", "asistencia", "ausente", "total")


def heads(pages: DataFrame) -> DataFrame:
    """(page_id, title, lang, n_links)."""
    return pages.select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", r'<html[^>]*lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit(r"<a\s"), F.lit(0))).cast("long").alias("n_links"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href), each once."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href")).distinct()


def cells(pages: DataFrame) -> DataFrame:
    """(page_id, row, cells): the cells of every table row as plain text."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "body"))
    plain = F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " ")))
    return rows.select("page_id", F.col("row").cast("long").alias("row"), plain.alias("cells"))


def carried_headers(pages: DataFrame) -> DataFrame:
    """(page_id, pos, piece, header): list and text pieces with the last heading above them."""
    p = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<(?:li|h1|h2|p)>[^<]*"), F.lit(0))).alias("pos", "piece"))
    header = F.last(F.when(F.col("piece").startswith("<h"), F.col("piece")), ignorenulls=True).over(Window.partitionBy("page_id").orderBy("pos"))
    return p.select("page_id", F.col("pos").cast("long").alias("pos"), "piece", header.alias("header"))


def nominal_votes(pages: DataFrame) -> DataFrame:
    """(page_id, number, name, member_id, option) of nominal lists: three cells, the name linked to a profile."""
    rows = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("body"))
    c = F.regexp_extract_all("body", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\s+", " "))
    r = rows.select("page_id", "body", c.alias("c")).filter(F.size("c") >= 3)
    return r.select("page_id", plain(F.col("c")[0]).try_cast("int").alias("number"), plain(F.col("c")[1]).alias("name"), F.nullif(F.regexp_extract("body", r"iddipt=(\d+)", 1), F.lit("")).cast("long").alias("member_id"), rules.option_of_deputy(plain(F.col("c")[2])).alias("option")).filter("number is not null")


def breakdown(pages: DataFrame) -> DataFrame:
    """(page_id, party, a_favor, en_contra, abstencion, asistencia, ausente, total) of rows with seven numeric cells."""
    c = cells(pages).filter(F.size("cells") >= 7)
    n = [F.try_element_at("cells", F.lit(i)).try_cast("int") for i in range(2, 8)]
    names = ("a_favor", "en_contra", "abstencion", "asistencia", "ausente", "total")
    return c.select("page_id", F.element_at("cells", 1).alias("party"), *[x.alias(k) for x, k in zip(n, names, strict=True)]).dropna(subset=list(names[:5]))


def _text(x):
    """Plain text of a piece of a page."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " "))


def _first(pattern: str, column: str = "html", group: int = 1):
    """The group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def breakdown_totals(pages: DataFrame) -> DataFrame:
    """(page_id, a_favor .. total): the row named Total, or the sums of the parties' rows on pages without one."""
    rows = breakdown(pages).withColumn("is_total", F.lower("party").startswith("total"))
    given = rows.filter("is_total").groupBy("page_id").agg(*[F.max(c).alias(f"t_{c}") for c in COUNTS])
    summed = rows.filter("not is_total").groupBy("page_id").agg(*[F.sum(c).alias(f"s_{c}") for c in COUNTS])
    return summed.join(given, "page_id", "full").select("page_id", *[F.coalesce(f"t_{c}", f"s_{c}").cast("long").alias(c) for c in COUNTS])


def nominal_summary(pages: DataFrame) -> DataFrame:
    """(page_id, option, value) of the `Label: number` items of a list's summary."""
    items = F.regexp_extract_all("html", F.lit(r"(?i)((?:a favor|en contra|abstenci[oó]n|ausente)[^:<]*:\s*\d+)"), F.lit(1))
    r = pages.select("page_id", F.explode(items).alias("x"))
    return r.select("page_id", rules.option_of_deputy(F.regexp_extract("x", r"^([^:]*)", 1)).alias("option"), F.regexp_extract("x", r"(\d+)$", 1).cast("long").alias("value"))


def composition(pages: DataFrame) -> DataFrame:
    """(page_id, party_code, members): party numbers of the links, each once, and the total of the caption."""
    total = _first(r'(?is)<figcaption.*?<span class="numero">\s*(\d+)').cast("long")
    codes = F.regexp_extract_all("html", F.lit(r"listado_diputados_gpnp\.php\?tipot=(\d+)"), F.lit(1))
    return pages.select("page_id", total.alias("members"), F.explode(F.array_distinct(codes)).alias("c")).select("page_id", F.col("c").cast("long").alias("party_code"), "members")


def listed_events(pages: DataFrame) -> DataFrame:
    """(page_id, event_code, number, title, day): linked events of listings, with the date header above them."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "body"))
    code = F.regexp_extract("body", r"votaciont=(\d+)", 1)
    header = F.when(code == "", F.nullif(rules.spelled_date(_text(F.col("body"))), F.lit("")))
    day = F.last(header, ignorenulls=True).over(Window.partitionBy("page_id").orderBy("pos"))
    cell = F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), _text)
    r = rows.select("page_id", code.alias("code"), cell.alias("c"), day.alias("day")).filter("code <> ''")
    return r.select("page_id", F.col("code").cast("long").alias("event_code"), F.get("c", F.lit(0)).try_cast("int").alias("number"), F.get("c", F.lit(1)).alias("title"), "day")


def senate_events(pages: DataFrame) -> DataFrame:
    """(page_id, term, day, description, pro, contra, abstention): heads of senate pages; the term from the first heading, else from anywhere in the page."""
    heading, body = _text(_first(r"(?is)<h3[^>]*>(.*?)</h3>")), _text(F.col("html"))
    term = F.coalesce(F.nullif(rules.term_in_text(F.coalesce(heading, F.lit(""))), F.lit("")), F.nullif(rules.term_in_text(body), F.lit("")))
    day = F.nullif(rules.natural_date(F.coalesce(_text(_first(r'(?is)<div class="[^"]*col-sm-12[^"]*">((?:(?!</div>).)*\d{1,2} de \w+ de \d{4}.*?)</div>')), F.lit(""))), F.lit(""))
    foot = F.upper(_text(F.coalesce(_first(r"(?is)<tfoot>(.*?)</tfoot>"), F.lit(""))))
    count = lambda word: F.coalesce(F.regexp_extract(foot, word + r"\D*(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
    return pages.select("page_id", term.alias("term"), day.alias("day"), _text(_first(r'(?is)<p class="descripcion">(.*?)</p>')).alias("description"), count("PRO").alias("pro"), count("CONTRA").alias("contra"), count("ABSTENCI").alias("abstention"))


def senate_votes(pages: DataFrame) -> DataFrame:
    """(page_id, number, name, party, option) of senate vote tables."""
    rows = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("body"))
    r = rows.select("page_id", F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), _text).alias("c")).filter("size(c) >= 4")
    return r.select("page_id", F.regexp_extract(F.col("c")[0], r"(\d+)", 1).try_cast("int").alias("number"), rules.clean_senator_name(F.col("c")[1]).alias("name"), F.upper(F.col("c")[2]).alias("party"), rules.option_of_senator(F.col("c")[3]).alias("option"))


def senate_counts(pages: DataFrame) -> DataFrame:
    """(page_id, party, a_favor, en_contra, abstencion) from the vote tables; those absent are not counted, parties without a name left out."""
    v = senate_votes(pages).filter("party <> ''")
    return v.groupBy("page_id", "party").agg(*[F.count_if(F.col("option") == o).alias(o) for o in ("a_favor", "en_contra", "abstencion")])


def deputy_profiles(pages: DataFrame) -> DataFrame:
    """(page_id, name, principle, state, district, birth, email, substitute, party) of deputies' pages; missing ones null."""
    field = lambda label: _text(_first(rf"(?is)<p[^>]*>[^<]*{label}\s*:[^<]*<b>(.*?)</b>"))
    return pages.select(
        "page_id", rules.plain_name(_text(_first(r'(?is)<h1[^>]*class="header-name"[^>]*>(.*?)</h1>'))).alias("name"), field("Principio de elecci[oó]n").alias("principle"), field("Entidad").alias("state"), field("Distrito").try_cast("int").alias("district"),
        rules.profile_date(field("Nacimiento")).alias("birth"), F.lower(_first(r"(?i)mailto:([^\"'>]+)")).alias("email"), field("Suplente").alias("substitute"), F.lower(_first(r'(?is)<img[^>]*class="header-gp"[^>]*src="(?:[^"]*/)?([^"/.]+)\.')).alias("party"),
    )


def senator_profiles(pages: DataFrame, least: int = 5000) -> DataFrame:
    """(page_id, name, gender, seat, state, party) of senators' pages that hold at least so many characters and the name heading."""
    title = _text(_first(r'(?is)<h2[^>]*class="nSenador"[^>]*>(.*?)</h2>'))
    kind = F.lower(_text(_first(r'(?is)<h3[^>]*class="tipoEleccion"[^>]*>(.*?)</h3>')))
    seat = F.when(kind.contains("lista nacional"), "plurinominal").otherwise(rules.seat_of_principle(kind))
    whole = pages.filter((F.length("html") >= least) & F.col("html").contains('class="nSenador"'))
    return whole.select(
        "page_id", F.trim(F.regexp_replace(title, r"(?i)^Senadora?\s+", "")).alias("name"), F.when(title.rlike(r"(?i)^Senadora\b"), "F").when(title.rlike(r"(?i)^Senador\b"), "M").alias("gender"), seat.alias("seat"),
        F.lower(_first(r'(?i)src="[^"]*/estados/([^"/.]+)\.')).alias("state"), F.lower(_first(r'(?i)src="[^"]*/partidos/([^"/.]+)\.')).alias("party"),
    )


def labelled_cells(pages: DataFrame) -> DataFrame:
    """(page_id, birth, principle) of old profiles: the cell after the one with the label."""
    after = lambda words: _text(_first(rf"(?is)<td[^>]*>(?:(?!</td>).)*(?:{words})(?:(?!</td>).)*</td>\s*<td[^>]*>(.*?)</td>"))
    return pages.select("page_id", rules.profile_date(after("nacimiento|onom[aá]stico")).alias("birth"), F.nullif(after("tipo de elecci|principio de elecci"), F.lit("")).alias("principle"))
