"""DuckDB SQL for the results of the queries that SQL can express."""

_ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def lower_ascii(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP8 = f"""
with d as (select doc_id, regexp_extract_all({lower_ascii("coalesce(text, '')")}, '{_ALNUM}') w from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all({lower_ascii("coalesce(text, '')")}, '{_ALNUM}') w from benchmark where item_id is not null),
bw as (
  select distinct item, least(10, len(w)) n, list_slice(w, i, i + least(10, len(w)) - 1) g
  from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (
  select doc_id, i, n, list_slice(w, i, i + n - 1) g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n)),
m as (select doc_id, i, n, item from dw join bw using (n, g)),
hits as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from m) group by 1),
items as (select doc_id, count(distinct item) n_items, array_to_string(list_sort(list(distinct item)), ',') s from m group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""

_SPACED = "[^\\x20\\x09-\\x0D]+"

OP7 = f"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') w from documents),
g as (select doc_id, i, list_slice(w, i, i + 12) x from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13)),
f as (select x, min(doc_id) first from g group by x having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 13)) p from g join f using (x) where doc_id > first)),
r as (select doc_id, list(p) ps from gone group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(len(ps), 0)::bigint n_removed,
  sha256(array_to_string(list_filter(w, lambda t, i: ps is null or not list_contains(ps, i)), ' ')) kept_sha256
from d left join r using (doc_id)
"""

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"



def _joined(units: str) -> str:
    return f"case when gap = ' ' then array_to_string({units}, ' ') else array_to_string({units}, '') end"


#: Two lines of which one has ten words or more count in words, others in characters; variants of both kinds are
#: kept apart. A line one unit short of its kind only gets gaps.
OP4 = f"""
with l as (
  select doc_id, line - 1 line, {_WORDS.format("body")} w
  from (select doc_id, unnest(string_split(text, chr(10))) body, unnest(range(1, len(string_split(text, chr(10))) + 1)) line from documents where text is not null)),
f as (select w, min((doc_id, line)) f from l where len(w) >= 1 group by w),
e as (select doc_id, line from l join f using (w) where (doc_id, line) <> f),
q as (
  select f, ' ' gap, w from f where len(w) >= 9
  union all select f, '', string_split(array_to_string(w, ' '), '') from f where len(w) < 10),
c as (select f, gap, w, len(w) n, len(w) >= 10 whole, list_slice(w, 1, 5) p, list_slice(w, len(w) - 4, len(w)) s from q where len(w) >= 9),
k as (
  select * from c
  where (gap, p) in (select (gap, p) from c group by gap, p having count(*) > 1) or (gap, s) in (select (gap, s) from c group by gap, s having count(*) > 1)),
v as (
  select f, md5(gap || chr(9) || {_joined("list_slice(w, 1, i)")} || chr(10) || {_joined("list_slice(w, i + 2, n)")}) x
  from (select *, unnest(range(0, n)) i from k where whole)
  union select f, md5(gap || chr(9) || {_joined("list_slice(w, 1, i)")} || chr(10) || {_joined("list_slice(w, i + 1, n)")})
  from (select *, unnest(range(0, n + 1)) i from k)),
g as (select x, min(f) g from v group by x having min(f) < max(f)),
r as (select distinct f[1] doc_id, f[2] line from v join g using (x) where f > g),
gone as (select doc_id, line, true exact from e union all select doc_id, line, false from r),
t as (
  select doc_id, count(*) filter (exact) n_exact, count(*) filter (not exact) n_near, list(line) lines from gone group by doc_id)
select d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::bigint n_lines, coalesce(n_exact, 0)::bigint n_exact, coalesce(n_near, 0)::bigint n_near,
  sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: t.lines is null or not list_contains(t.lines, i - 1)), chr(10))) kept_sha256
from documents d left join t using (doc_id)
"""

#: Components of ``pair`` (a, b) over the ids of ``node`` (id).
_COMPONENTS = """
edge as (select a, b from pair union select b, a from pair),
reach(id, r) as (select id, id from node union select reach.id, edge.b from reach join edge on edge.a = reach.r),
component as (select id, min(r) component_id from reach group by id)
"""

OP9 = f"""
with recursive d as (select doc_id, regexp_extract_all({lower_ascii("coalesce(text, '')")}, '{_SPACED}') w from documents),
s as (
  select distinct doc_id, list_slice(w, i, i + least(5, len(w)) - 1) x
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
common as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
pair as (select a, b from common join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 85 * (na.n + nb.n - k)),
node as (select doc_id id from d), {_COMPONENTS}
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id, doc_id = component_id kept
from d left join n using (doc_id) join component on id = doc_id
"""

OP2 = f"""
with recursive v as (
  select vec_id, label, embedding::double[] e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) norm from v),
pair as (
  select a.vec_id a, b.vec_id b from u a join u b on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
node as (select vec_id id from embeddings), {_COMPONENTS},
links as (select id, count(*) n from (select a id from pair union all select b from pair) group by id)
select vec_id, coalesce(n, 0)::bigint n_links, component_id, vec_id = component_id kept
from embeddings join component c on c.id = vec_id left join links l on l.id = vec_id
"""

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

OP13 = f"""
with d as (select doc_id, regexp_extract_all({lower_ascii("text")}, '{_TERM}') w from documents where text is not null),
n as (select doc_id, len(w)::bigint n from d where len(w) > 0),
totals as (select count(*) docs, sum(n)::bigint terms from n),
b as (select item_id, unnest(regexp_extract_all({lower_ascii("text")}, '{_TERM}')) t from benchmark where text is not null),
q as (select item_id, t, count(*) c from b group by all),
tf as (select doc_id, t, count(*) tf from (select doc_id, unnest(w) t from d) where t in (select t from q) group by all),
weight as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint w from (select t, count(*) df from tf group by t), totals),
length as (select doc_id, 100 - 75 + ((75 * n * docs) // terms) m from n, totals),
part as (select doc_id, t, (w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint v from tf join weight using (t) join length using (doc_id)),
scored as (select item_id, doc_id, sum(c * v)::bigint score from q join part using (t) group by all having sum(c * v) > 0),
ranked as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scored)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""

OP11 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, x.vec_id, list_inner_product(q.e, x.e)::bigint score
  from v q join v x on q.vec_id % 50 = 0 and x.vec_id <> q.vec_id and len(q.e) = len(x.e)),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

ORACLES = {"op11_pivots": OP11, "op13_lexical": OP13, "op4_lines": OP4, "op4_every_line": OP4, "op2_rabitq": OP2, "op7_substring": OP7, "op9_minhash": OP9, "op8_decontaminate": OP8}
