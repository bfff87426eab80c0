"""The evolution of the agreement graph over sliding windows of each term."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import agreement as ag
from plenum.operators import evolution as ev
from plenum.operators import windows as wi
from plenum.operators.graph import stored

from .base import query
from .views import votes

SIZE, OVERLAP = 100, 20

#: Windows, edges, parties as parts, and the measures of each window.
EVOLUTION = f"""# e0 as (select vote_event_id, min(leg) as leg, min(start_date) as start_date from votes group by 1),
e1 as (select *, row_number() over (partition by leg order by start_date, vote_event_id) - 1 as i from e0),
br as (select cast(leg as varchar) || '/' || cast(k as varchar) as window_id, e1.* from e1, range(100000) r(k) where k * {SIZE - OVERLAP} <= i and i < k * {SIZE - OVERLAP} + {SIZE}),
wi as (select window_id, min(leg) as leg, min(start_date) as first, max(start_date) as last, count(*) as n_events from br group by 1),
wo as (select *, lag(window_id) over (order by first, window_id) as before from wi),
v as (select br.window_id, votes.* from votes join br using (vote_event_id)),
ed as (select x.window_id, x.voter_id as a, y.voter_id as b, count(*) filter (x.option = y.option) / count(*) as weight from v x join v y on x.window_id = y.window_id and x.vote_event_id = y.vote_event_id and x.voter_id < y.voter_id
 where x.option <> 'ausente' and y.option <> 'ausente' group by 1, 2, 3 having count(*) filter (x.option = y.option) > 0),
pn as (select window_id, voter_id, grp, count(*) as n from v group by 1, 2, 3),
pa as (select window_id, voter_id, grp as part from pn qualify row_number() over (partition by window_id, voter_id order by n desc, grp) = 1),
pe as (select ed.*, p.part as pa, q.part as pb from ed join pa p on p.window_id = ed.window_id and p.voter_id = a join pa q on q.window_id = ed.window_id and q.voter_id = b),
dg as (select window_id, part, sum(weight) as degree, sum(own) as own from (select window_id, pa as part, weight, case when pa = pb then weight / 2 else 0 end as own from pe union all select window_id, pb, weight, case when pa = pb then weight / 2 else 0 end from pe) group by 1, 2),
mo as (select window_id, round(2 * sum(own) / sum(degree) - sum(degree * degree) / (sum(degree) * sum(degree)), 6) as modularity from dg group by 1),
tp as (select window_id, part as top from pa group by 1, 2 qualify row_number() over (partition by window_id order by count(*) desc, part) = 1),
fr as (select window_id, round(avg(weight), 6) as frontier from pe join tp using (window_id) where (pa = top) <> (pb = top) group by 1),
sz as (select window_id, count(*) as n_edges, round(avg(weight), 6) as mean_weight from ed group by 1),
nv as (select window_id, count(distinct voter_id) as n_voters from v group by 1),
np as (select window_id, count(distinct part) as n_parts from pa group by 1),
bo as (select wo.window_id, p.voter_id, p.part as p, q.part as q from wo join pa p on p.window_id = wo.window_id join pa q on q.window_id = wo.before and q.voter_id = p.voter_id),
ce as (select window_id, p, q, count(*) as n from bo group by 1, 2, 3),
s1 as (select window_id, sum(n) as n, sum(n * (n - 1) / 2) as bo from ce group by 1),
s2 as (select window_id, sum(n * (n - 1) / 2) as ro from (select window_id, p, sum(n) as n from ce group by 1, 2) group by 1),
s3 as (select window_id, sum(n * (n - 1) / 2) as co from (select window_id, q, sum(n) as n from ce group by 1, 2) group by 1),
ar as (select window_id, round(case when n < 2 then 0 when (ro + co) / 2 = ro * co / (n * (n - 1) / 2) then 1 else greatest(least((bo - ro * co / (n * (n - 1) / 2)) / ((ro + co) / 2 - ro * co / (n * (n - 1) / 2)), 1), -1) end, 4) as ari from s1 join s2 using (window_id) join s3 using (window_id)),
bundle as (select wo.window_id, leg, first, last, n_events, n_voters, coalesce(n_edges, 0) as n_edges, case when n_voters > 1 then round(2.0 * coalesce(n_edges, 0) / (n_voters * (n_voters - 1)), 6) else 0 end as density, mean_weight, modularity, coalesce(n_parts, 0) as n_parts, frontier, ari
 from wo left join nv using (window_id) left join sz using (window_id) left join mo using (window_id) left join np using (window_id) left join fr using (window_id) left join ar using (window_id))"""


def _bundle(s, d):
    v = stored(votes(s, d).select("vote_event_id", "voter_id", "option", "grp", "leg", "start_date", "chamber"))
    bridge = stored(wi.sliding(wi.events(v), SIZE, OVERLAP).select("window_id", "vote_event_id", "leg", "start_date"))
    return ev.bundle(v, bridge, lambda v: ag.primary_party(v, ("window_id",)).withColumnRenamed("party", "part"))


query("evolution", EVOLUTION + " select * from bundle")(lambda s, d: _bundle(s, d))
query("last_window_modularity", EVOLUTION + " select leg, arg_max(window_id, (first, window_id)) as window_id, arg_max(modularity, (first, window_id)) as modularity from bundle group by 1")(lambda s, d: ev.last_of_term(_bundle(s, d)))
