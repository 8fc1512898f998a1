"""DuckDB SQL for the queries that SQL can express, and for the pipeline stages made of them."""

from __future__ import annotations

from bizmetrics.llm.license_scan import TEMPLATES
from bizmetrics.llm.quality_rules import CHARACTER_CLASSES, COMMON_WORDS
from bizmetrics.llm.source_mixing import WEIGHTS

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _words(column: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({column}, ''), '{SPACE}+'), lambda w: w <> '')"


def license_scan(threshold: float = 0.8) -> str:
    listed = ", ".join(f"({_text(k)}, {_text(v)})" for k, v in sorted(TEMPLATES.items()))
    words = "string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    pairs = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return f"""
with templates as (
  select template_id, {pairs} as t from (select template_id, {words.format("template")} as w from (values {listed}) v(template_id, template))
), lines as (
  select doc_id, string_split(text, chr(10)) as l, text from documents where text is not null
), units as (
  select doc_id, -1::bigint as line_no, text as unit from lines
  union all
  select doc_id, unnest(range(0, len(l)))::bigint as line_no, unnest(l) as unit from lines
), sets as (
  select distinct doc_id, line_no, {pairs} as b from (select doc_id, line_no, {words.format("unit")} as w from units)
), scored as (
  select doc_id, line_no, template_id, 2 * len(list_intersect(b, t))::double / (len(b) + len(t)) as dice
  from sets, templates where len(b) > 0
)
select doc_id, line_no, template_id, dice from scored where dice >= {threshold}
qualify row_number() over (partition by doc_id, line_no order by dice desc, template_id) = 1"""


def quality_rules(class_limit: float = 0.25, word_limit: float = 0.6, min_chars: int = 200, min_words: int = 100) -> str:
    rest, classes = "coalesce(text, '')", []
    for pattern in CHARACTER_CLASSES.values():
        less = f"regexp_replace({rest}, {_text(pattern)}, '', 'g')"
        classes.append(f"length({rest}) - length({less})")
        rest = less
    classes.append(f"length({rest})")
    lists = " ".join(f"when {_text(k)} then [{', '.join(map(_text, v))}]" for k, v in COMMON_WORDS.items())
    languages = ", ".join(map(_text, COMMON_WORDS))
    n_classes, n_words = len(classes), len(next(iter(COMMON_WORDS.values()))) + 1
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"
    space = list(CHARACTER_CLASSES).index("space") + 1
    symbol = list(CHARACTER_CLASSES).index("symbol") + 1

    def distance(a: str, b: str) -> str:
        p, q = f"({a}[i] / list_sum({a})::double)", f"({b}[i] / list_sum({b})::double)"
        part = "case when {0} > 0 then {0} * log2(2 * {0} / ({0} + {1})) else 0 end"
        terms = f"[{part.format(p, q)} + {part.format(q, p)} for i in range(1, len({a}) + 1)]"
        return f"case when list_sum({a}) > 0 and list_sum({b}) > 0 then sqrt(greatest(list_sum({terms}) / 2, 0)) end"

    return f"""
with base as (
  select row_number() over () as k, doc_id, lang, coalesce(text, '') as body, {_words("text")} as w,
    [{", ".join(classes)}] as cc,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')) as l
  from documents
), windows as (
  select k, p, [w[p], w[p + 1], w[p + 2], w[p + 3], w[p + 4]] as g from (select k, w, unnest(range(1, len(w) - 3)) as p from base)
), repeated as (
  select k, p from windows qualify count(*) over (partition by k, g) > 1
), covered as (
  select k, count(distinct p + d) as n from repeated, range(0, 5) r(d) group by k
), counted as (
  select k, doc_id, lang, cc, len(w) as n_words, length(body) as n_chars, length(body) - cc[{space}] as word_chars, cc[{symbol}] as n_symbols,
    len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
    case when lang in ({languages}) then [len(list_filter(w, lambda x: lower(x) = y)) for y in case lang {lists} end] end as found, w
  from base left join covered c using (k)
), whole as (
  select *, list_append(found, n_words - list_sum(found)) as wc,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counted
), reference as (
  select lang, {sums("cc", n_classes)} as cr, {sums("wc", n_words)} as wr
  from whole where not base_failed and lang in ({languages}) group by lang
), judged as (
  select whole.*, {distance("cc", "cr")} as cd, {distance("wc", "wr")} as wd from whole left join reference using (lang)
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not coalesce(n_chars >= {min_chars} and cd > {class_limit}, false)
    and not coalesce(n_words >= {min_words} and wd > {word_limit}, false) as kept,
  round(cd, 4) as class_distance, round(wd, 4) as word_distance
from judged"""


def line_dedup() -> str:
    return f"""
with docs as (
  select doc_id, text, string_split(text, chr(10)) as l from documents
), windows as (
  select distinct doc_id, text, p, md5(l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2]) as key
  from (select doc_id, text, l, unnest(range(1, len(l) - 1)) as p from docs)
  where regexp_matches(l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2], '{NOT_SPACE}')
), later as (
  select doc_id, text, p from windows
  qualify row_number() over (partition by key order by doc_id nulls first, md5(text), p) > 1
), cuts as (
  select doc_id, text, list(distinct p + d) as gone from later, range(0, 3) r(d) group by doc_id, text
)
select d.doc_id, coalesce(len(d.l), 0)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed,
  md5(case when gone is null then d.text else array_to_string([d.l[i] for i in range(1, len(d.l) + 1) if not list_contains(gone, i)], chr(10)) end) as kept_md5
from docs d left join cuts c on d.doc_id is not distinct from c.doc_id and d.text = c.text"""


def warc_bundles(revisit_bytes: int = 100) -> str:
    return f"""
with hashed as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), firsts as (
  select *, case when payload_bytes >= {revisit_bytes} then min(page_id) over (partition by payload_digest, payload_bytes >= {revisit_bytes}) end as first_id from hashed
)
select page_id, payload_bytes, payload_digest,
  case when first_id is not null and page_id is distinct from first_id then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first_id then first_id end as refers_to
from firsts"""


def mixed(documents: str = "documents", seed: str = "mix", share: float = 1.5, most: float = 2.0) -> str:
    """Common table expressions; the last one, ``mixed``, has a row per document."""
    weights = ", ".join(f"{w}.0::double" for w in WEIGHTS)
    return f"""
sized as (
  select row_number() over () as k, *, len({_words("text")}) as size, md5({_text(seed)} || coalesce(doc_id::varchar, '')) as shuffle from {documents}
), sources as (
  select *, source_size * {most}::double as cap, sum(source_size) over () * {share}::double as budget,
    [{weights}][(row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1] as weight
  from (select source, sum(size) as source_size from sized group by source)
), leveled as (
  select *, cap / weight as fill, row_number() over (order by cap / weight, source nulls last) as place, (budget - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from sources
), wanted as (
  select source, source_size, budget, coalesce(least(cap, weight * (select first(level order by place) from leveled where level <= fill)), cap) as target from leveled
), queued as (
  select sized.*, source_size, target, budget, sum(size) over (partition by sized.source order by shuffle, doc_id, size rows unbounded preceding) as served
  from sized join wanted on sized.source is not distinct from wanted.source
), copies as (
  select k, size, budget, served::double / target as finish, coalesce('s' || source, '~') as s, shuffle, 0 as copy from queued where target > 0 and size > 0
  union all
  select k, size, budget, (served + source_size) / target, coalesce('s' || source, '~'), shuffle, 1 from queued where target > 0 and size > 0
), kept as (
  select k, sum(size) as taken from (
    select k, size, budget, sum(size) over (order by finish, s, shuffle, copy rows unbounded preceding) as total from copies
  ) where total <= budget group by k
), mixed as (
  select queued.* exclude (served, budget), coalesce(taken, 0)::bigint as taken from queued left join kept using (k)
)"""


def source_mixing() -> str:
    return f"""with {mixed()}
select doc_id, size::bigint as size, source_size::bigint as source_size, target::double as target, taken from mixed"""


def filter_audit() -> str:
    return f"""
with recursive marked as (
  select coalesce(lang, '') as part, doc_id, coalesce(text, '') as body, {_words("text")} as w from documents
), failing as (
  select part, doc_id,
    (len(w) < 100)::int + (100 * len(list_distinct(w)) < 80 * len(w))::int * 2
    + (100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 10 * length(body))::int * 4
    + regexp_matches(body, '[#$%&*|]')::int * 8 + coalesce(doc_id > min(doc_id) over (partition by body), false)::int * 16 as mask
  from marked
), flagged as (
  select part, mask, count(*) as n,
    count(*) filter (doc_id in (select doc_id from labels where quality = 1 and doc_id is not null)) as good,
    count(*) filter (doc_id in (select doc_id from labels where toxic = 1 and doc_id is not null)) as toxic
  from failing group by all
), letters as (
  select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)
), walks as (
  select '' as walk, 0 as seen
  union all
  select walk || letter, seen | bit from walks, letters where seen & bit = 0
), steps as (
  select o.walk as filter_order, s.step::int as step, l.bit, p.seen as prior
  from (select walk from walks where length(walk) = 5) o, range(1, 6) s(step), letters l, walks p
  where l.letter = o.walk[s.step] and p.walk = left(o.walk, s.step - 1)
), sums as (
  select part, bit, prior, sum(n) filter (mask & (bit | prior) = 0) as kept,
    coalesce(sum(n) filter (mask & bit > 0 and mask & prior = 0), 0) as removed,
    coalesce(sum(n) filter (mask & bit > 0 and mask & prior > 0), 0) as redundant,
    coalesce(sum(n) filter (mask = bit), 0) as unique_fails,
    coalesce(sum(good) filter (mask & bit > 0 and mask & prior = 0), 0) as good_lost,
    coalesce(sum(toxic) filter (mask & bit > 0 and mask & prior = 0), 0) as toxic_lost
  from flagged, (select distinct bit, prior from steps) group by part, bit, prior
), cells as (
  select part, filter_order, step, bit, kept, removed, redundant, unique_fails, good_lost, toxic_lost from sums join steps using (bit, prior)
)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint as shapley
from cells"""


def substring_dedup(width: int = 20) -> str:
    """For tables in which every document has an id of its own."""
    return f"""
with docs as (
  select doc_id, {_words("text")} as w from documents
), windows as (
  select doc_id, p, md5(array_to_string(w[p:p + {width - 1}], ' ')) as key
  from (select doc_id, w, unnest(range(1, len(w) - {width - 2})) as p from docs)
), later as (
  select doc_id, p from windows qualify row_number() over (partition by key order by doc_id, p) > 1
), cuts as (
  select doc_id, list(distinct p + d) as gone from later, range(0, {width}) r(d) group by doc_id
), marked as (
  select docs.doc_id, w, coalesce(gone, []) as gone from docs left join cuts using (doc_id)
), kept as (
  select k.doc_id, string_agg(k.word, ' ' order by k.i) as kept
  from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from docs) k
  anti join (select doc_id, unnest(gone) as i from cuts) g on k.doc_id = g.doc_id and k.i = g.i
  group by k.doc_id
)
select m.doc_id, len(w)::bigint as n_words, len(m.gone)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from marked m left join kept using (doc_id)"""
