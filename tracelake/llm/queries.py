"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from tracelake.llm import fim, preference
from tracelake.llm.bpe import op7_bpe
from tracelake.llm.decontaminate import op10_decontaminate
from tracelake.llm.fim import op13_fill_in_middle
from tracelake.llm.language import op6_language
from tracelake.llm.licenses import op9_licenses
from tracelake.llm.periodic import op11_periodic_runs
from tracelake.llm.preference import op3_preference
from tracelake.llm.quality import op2_quality
from tracelake.llm.simhash import op5_simhash
from tracelake.llm.tokenfile import op12_token_files
from tracelake.llm.toxicity import op1_toxicity
from tracelake.llm.warc import op8_warc
from tracelake.llm.winnow import op4_winnow

QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_quality, op3_preference, op4_winnow, op5_simhash, op6_language, op7_bpe, op8_warc, op9_licenses, op10_decontaminate, op11_periodic_runs, op12_token_files, op13_fill_in_middle)
}

ORACLE_SQL = {
    "op3_preference": preference.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
    "op8_warc": """
with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, n as payload_bytes, p.d as payload_digest,
 case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
 case when first <> page_id then first end as refers_to
from p left join f on p.d = f.d and n >= 100
""",
    "op10_decontaminate": r"""
with doc as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
item as (select cast(item_id as varchar) as item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
iw as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as k from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from item where len(w) > 0)),
size as (select distinct n from iw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, size where len(w) >= n)),
m as (select distinct doc_id, dw.n, i, item_id from dw join iw on dw.n = iw.n and dw.k = iw.k),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from m) group by doc_id)
select doc.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
 sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join h on doc.doc_id = h.doc_id left join t on doc.doc_id = t.doc_id
""",
}
