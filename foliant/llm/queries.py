"""The queries of the training-data operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from foliant.llm.bpe import op1_bpe
from foliant.llm.decontaminate import op2_decontamination
from foliant.llm.divergence import op12_source_divergence
from foliant.llm.langid import op3_language_id
from foliant.llm.licenses import op9_license_scans
from foliant.llm.mixing import op13_source_mixing
from foliant.llm.pairs import op11_co_bucketed_pair
from foliant.llm.quality import op5_quality_rules
from foliant.llm.secrets import op10_secret_scans
from foliant.llm.shards import op6_sharding
from foliant.llm.simhash import op7_simhash
from foliant.llm.suffixes import op8_suffix_dedup
from foliant.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_license_scans": op9_license_scans,
    "op10_secret_scans": op10_secret_scans,
    "op11_co_bucketed_pair": op11_co_bucketed_pair,
    "op12_source_divergence": op12_source_divergence,
    "op13_source_mixing": op13_source_mixing,
}

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op2_decontamination": f"""
with i as (select item_id, {WORDS} as ws from benchmark),
win as (select distinct item_id, array_to_string(ws[s:s + 12], ' ') as win, least(len(ws), 13) as n
        from (select item_id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) as s from i where len(ws) > 0)),
d as (select doc_id, {WORDS} as ws from documents),
sizes as (select distinct n from win),
p as (select doc_id, n, unnest(range(1, len(ws) - n + 2)) as s, ws from d cross join sizes where len(ws) >= n),
occ as (select doc_id, s, win.n, item_id from p join win on win.n = p.n and win.win = array_to_string(ws[s:s + p.n - 1], ' ')),
hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(s, s + n)) as q from occ) group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items,
              array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as items from occ group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
""",
    "op5_quality_rules": r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
g as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) as i from w),
win as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as win from g),
rep as (select doc_id, i, count(*) over (partition by doc_id, win) as n from win),
cov as (select doc_id, count(distinct p) as n_repeat_words
        from (select doc_id, unnest(range(i, i + 8)) as p from rep where n > 1) group by doc_id),
ln as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
          from ln where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words,
             cast(length(array_to_string(ws, '')) as bigint) as word_chars,
             cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
             coalesce(n_lines, 0) as n_lines
      from w left join cov using (doc_id) left join lines using (doc_id)),
b as (select *, cast(n_words < 20 as bigint) + 2 * cast(100 * n_repeat_words > 30 * n_words as bigint)
             + 4 * cast(4 * n_symbols > n_words as bigint)
             + 8 * cast(n_lines >= 5 and 2 * n_dup_lines > n_lines as bigint)
             + 16 * cast(word_chars < 2 * n_words as bigint)
             + 32 * cast(word_chars > 20 * n_words as bigint) as failed_rules from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_rules & 3) <> 0 as base_failed, failed_rules = 0 as kept, n_lines, failed_rules from b
""",
    "op12_source_divergence": r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
g as (select distinct lang, source from d),
t as (select r, lang, source, unnest(ws) as term from d),
c as (select lang, source, term, count(*) as n from t group by all),
k as (select lang, term, count(*) as n from t group by lang, term having count(distinct r) >= 10),
v as (select g.lang, (select count(*) from k where k.lang = g.lang) as v, (select coalesce(sum(n), 0) from k where k.lang = g.lang) as n from (select distinct lang from g) g),
gn as (select g.lang, g.source, coalesce(sum(c.n), 0) as n from g left join (select c.* from c join k using (lang, term)) c using (lang, source) group by all),
p as (select gn.lang, gn.source, k.term, coalesce(c.n, 0) as n,
             1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (gn.n + 2 * v.v) as p,
             1 + (1000000000::hugeint * (k.n + 2)) // (v.n + 2 * v.v) as q
      from gn join k using (lang) join v using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = k.term),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(f.value, 0) as bigint) as value
          from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // (p + q) as bigint) as value from p where n > 0 and p > q),
r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
      from (select * from pairs union all select * from terms))
select * from r where part = 'pair' or rank <= 10
""",
}
