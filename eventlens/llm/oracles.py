"""DuckDB SQL for the queries that SQL can express."""
from __future__ import annotations

from eventlens.llm.license_rules import rules
from eventlens.llm.licenses import GAP, LOWER, PHRASES, UPPER

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _folded(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


def _wide(expression: str) -> str:
    """An expression over words with two spaces between and one at either end, so that neighbouring matches share none."""
    return " (?:" + expression.replace(" ", "  ") + ") "


def licenses() -> str:
    """Every word stands as `` word `` here; two spaces before a match are one word before it."""
    table = ",\n".join(
        f"({k}, {_text(r.needs[0])}, [{', '.join(map(_text, r.needs))}], {_text(r.label)}, {r.priority}, {r.weight}::double, {_text(_wide(r.expression))})"
        for k, r in enumerate(rules()))
    phrases = ", ".join(f"({_text(_wide(p))}, {_text(label)})" for p, label in PHRASES.items())
    spaces = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    place = lambda i: (f"({spaces(f'''array_to_string(gaps[1:{i}], '')''')} + {spaces(f'''array_to_string(found[1:{i} - 1], '')''')}) // 2")
    return f"""
with rules(rule, word, needs, label, priority, weight, pattern) as (values {table}),
phrases(pattern, label) as (values {phrases}),
flat as (select row_number() over () as r, doc_id, trim(regexp_replace({_folded('text')}, '{GAP}', ' ', 'g')) as flat from documents),
docs as (select r, doc_id, flat, case when flat = '' then '' else ' ' || replace(flat, ' ', '  ') || ' ' end as wide,
    case when flat = '' then [] else list_distinct(string_split(flat, ' ')) end as words from flat),
phrase_found as (select r, label, regexp_extract_all(wide, pattern) as found, string_split_regex(wide, pattern) as gaps
    from docs, phrases where regexp_matches(wide, pattern)),
phrase_places as (select r, label, {place('i')} as start
    from (select r, label, found, gaps, unnest(range(1, len(found) + 1)) as i from phrase_found)),
base as (select r, count(*) as n_base, min(start) as first_word, max(start) as last_word, list(distinct label) as base from phrase_places group by r),
tried as (select r, wide, rules.* from (select r, wide, words, unnest(words) as word from docs) d join rules using (word) where list_has_all(d.words, rules.needs)),
hit as (select r, rule, label, priority, weight, regexp_extract_all(wide, pattern) as found, string_split_regex(wide, pattern) as gaps
    from tried where regexp_matches(wide, pattern)),
detection as (select r, rule, label, priority, weight, {place('i')} as start, {place('i')} + {spaces('found[i]')} // 2 as stop
    from (select *, unnest(range(1, len(found) + 1)) as i from hit)),
kept as (select * from detection d where not exists (select 1 from detection e where e.r = d.r and e.start <= d.start and e.stop >= d.stop
    and (e.priority < d.priority or (e.priority = d.priority and e.stop - e.start > d.stop - d.start)))),
own as (select r, list(distinct label) as own, max(weight) as score from kept group by r)
select doc_id, cast(case when flat = '' then 0 else len(string_split(flat, ' ')) end as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base,
    cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
    coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') as labels,
    coalesce(score, 0.0::double) as score
from docs left join base using (r) left join own using (r)"""


def search() -> str:
    terms = lambda: f"regexp_extract_all({_folded('text')}, '{TERM}')"
    return f"""
with split as (select row_number() over () as r, doc_id, {terms()} as w from documents),
docs as (select r, doc_id, w, cast(len(w) as bigint) as n from split where len(w) > 0),
total as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_terms from docs),
tf as (select r, doc_id, n, term, cast(count(*) as bigint) as tf from (select r, doc_id, n, unnest(w) as term from docs) group by all),
df as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as weight
    from tf, total group by term, n_docs),
item as (select row_number() over () as i, item_id, {terms()} as w from benchmark),
asked as (select i, item_id, term, cast(count(*) as bigint) as times from (select i, item_id, unnest(w) as term from item) group by all),
scored as (select i, item_id, r, doc_id,
    cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * n_docs) // n_terms))))) as bigint) as score
    from asked join df using (term) join tf using (term), total where tf.doc_id is not null group by all)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by i order by score desc, doc_id) as rank from scored where score > 0) where rank <= 20"""


def archives() -> str:
    """Base 32 from the digest's hexadecimal form: five digits are four characters."""
    chars = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER) >> {shift}) & 31), 1)"
        for i in range(8) for shift in (15, 10, 5, 0))
    return f"""
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
m as (select *, min(page_id) over (partition by body) as first from p)
select page_id, cast(octet_length(encode(body)) as bigint) as payload_bytes, {chars} as payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type,
    case when page_id = first then null else first end as refers_to
from m"""
