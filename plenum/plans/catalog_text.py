"""Column rules and page jobs over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import rules as ru
from plenum.sources import pages as pg

from .base import query
from .views import table

query("motion_classes", "select doc_id, case when contains(upper(text),'CONSTITUCI') then 'mayoria_calificada' else 'mayoria_simple' end as requirement, case when contains(upper(text),'CONSTITUCI') then 'reforma_constitucional' when contains(upper(text),'LEY') then 'ley_secundaria' when contains(upper(text),'PRESUPUESTO') then 'ordinaria' when contains(upper(text),'DECRETO') and (contains(upper(text),'INGRESO') or contains(upper(text),'EGRESO')) then 'ordinaria' else 'otra' end as kind from documents", view=False)(lambda s, d: table(s, d, "documents").select("doc_id", ru.motion_requirement(F.col("text")).alias("requirement"), ru.motion_class(F.col("text")).alias("kind")))
query("name_keys", f"select doc_id, trim(regexp_replace(lower(translate(text,'{ru.MARKED}','{ru.PLAIN}')),'\\s+',' ','g')) as key from documents", view=False)(lambda s, d: table(s, d, "documents").select("doc_id", ru.name_key(F.col("text")).alias("key")))
query("dates", "select o_orderkey, strftime(cast(o_orderdate as date),'%Y-%m-%d') as a, strftime(cast(o_orderdate as date),'%Y-%m-%d') as b from orders", view=False)(lambda s, d: table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("x")).select("o_orderkey", ru.spelled_date(F.date_format("x", "d/M/yyyy")).alias("a"), ru.numeric_date(F.date_format("x", "dd-MM-yyyy")).alias("b")))
query("options", "select l_orderkey, l_linenumber, case l_returnflag when 'A' then 'a_favor' when 'R' then 'en_contra' else 'abstencion' end as deputy, case l_returnflag when 'A' then 'a_favor' when 'R' then 'en_contra' else 'abstencion' end as senator from lineitem", view=False)(lambda s, d: (lambda r: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", ru.option_of_deputy(F.when(r == "A", "A favor").when(r == "R", "En contra").otherwise("Solo asistencia")).alias("deputy"), ru.option_of_senator(F.when(r == "A", "PRO").when(r == "R", "CONTRA").otherwise("ABSTENCIÓN")).alias("senator")))(F.col("l_returnflag")))
query("page_heads", "select page_id, regexp_extract(html,'(?is)<title>(.*?)</title>',1) as title, regexp_extract(html,'<html[^>]*lang=\"([a-z]+)\"',1) as lang, cast(len(regexp_extract_all(html,'<a\\s')) as bigint) as n_links from pages", view=False)(lambda s, d: pg.heads(table(s, d, "pages")))
query("page_links", "select distinct page_id, unnest(regexp_extract_all(html,'href=\"([^\"]*)\"',1)) as href from pages", view=False)(lambda s, d: pg.links(table(s, d, "pages")))
query("page_cells", "with i as (select page_id, unnest(regexp_extract_all(html,'(?s)<li>(.*?)</li>',1)) as b, generate_subscripts(regexp_extract_all(html,'(?s)<li>(.*?)</li>',1),1) as k from pages) select page_id, cast(k-1 as bigint) as row, trim(regexp_replace(regexp_replace(b,'<[^>]*>',' ','g'),'\\s+',' ','g')) as cell from i", view=False)(lambda s, d: pg.cells(table(s, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("html", "<li>", "<tr><td>"), "</li>", "</td></tr>").alias("html"))).select("page_id", "row", F.get("cells", F.lit(0)).alias("cell")))
query("listing_headers", "with i as (select page_id, unnest(regexp_extract_all(html,'<(?:li|h1|h2|p)>[^<]*')) as b, generate_subscripts(regexp_extract_all(html,'<(?:li|h1|h2|p)>[^<]*'),1) as pos from pages) select page_id, cast(pos-1 as bigint) as pos, b as piece, last_value(case when b like '<h%' then b end ignore nulls) over (partition by page_id order by pos) as header from i", view=False)(lambda s, d: pg.carried_headers(table(s, d, "pages")))
