"""SQL for the registered queries, as DuckDB runs it on the same tables."""

from __future__ import annotations

from kelvara import lexicons as L
from kelvara.config import CHUNKING, SEARCH
from kelvara.functions.text import AGENT_FORMULA, BRACKET_FORMULA, FORMULA, KEYWORD, NUMBER, TOKEN, VARIABLE, WS
from kelvara.operators import calculation
from kelvara.operators.agent import CONTEXT
from kelvara.operators.reporting import MATERIALS, STANDARD
from kelvara.plans import fixtures
from kelvara.texts import AREA_ERRORS, ERRORS, GLOSSARY, NOT_FOUND, OTHER_ERROR, PROMPTS, UNKNOWN_ERROR, UNNAMED_LIBRARY

_CODE = r"(?i)(?:СП\s?\d+\.\d+|ГОСТ\s?\d+(?:-\d+)?|СНиП\s?[\d.-]+)"
_REF = r"(?i)(?:пункт\s?\d+(?:\.\d+)*|раздел\s?\d+(?:\.\d+)*)"
_STEP = f"query_id % {SEARCH.query_step} = 0"


TRIMMED = " ?!.,:;\"'«»()[]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def normalize(x: str) -> str:
    for pattern, to in (("\\x00", "' '"), ("\\r\\n?", "chr(10)"), ("[ \\t]+", "' '"), ("\\n{3,}", "chr(10) || chr(10)")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return strip(x)


def sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"


def any_of(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def starts(x: str, words) -> str:
    return "(" + " or ".join(f"starts_with({x}, {q(w)})" for w in words) + ")"


def table_like(x: str) -> str:
    lines = f"list_filter(list_transform(string_split_regex({x}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: {strip('l')}), lambda l: l <> '')"
    return (
        f"(contains({x}, '|') or (len({lines}) >= 2 and len(list_filter(({lines})[1:12], "
        f"lambda l: regexp_matches(l, '{WS}{{2}}') or len(regexp_extract_all(l, '\\p{{Nd}}+')) >= 3)) >= 2))"
    )


def domain_terms(x: str) -> str:
    stop = ", ".join(q(w) for w in L.STOP_WORDS)
    return f"(list_filter(list_transform(regexp_extract_all({x}, '{KEYWORD}'), lambda w: lower(w)), lambda w: w not in ({stop})))[1:15]"


def numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{NUMBER}'), lambda w: replace(w, ',', '.')::double)"


def query_type(x: str) -> str:
    t = f"trim(lower({x}))"
    return (
        f"case when {any_of(t, L.CALC_TRIGGERS)} then 'calculation' when {starts(t, L.DEFINITION_PREFIXES)} then 'definition' "
        f"when {any_of(t, L.COMPARISON_TRIGGERS)} then 'comparison' when {any_of(t, L.REGULATORY_TRIGGERS)} then 'regulatory' else 'search' end"
    )


def route(x: str) -> str:
    t = f"lower({strip(x)})"
    return f"case when {starts(t, L.DEFINITION_PREFIXES)} then 'definition' when {any_of(t, L.APP_CALC_TRIGGERS)} then 'calculation' when {any_of(t, L.APP_TABLE_TRIGGERS)} then 'table' else 'agent' end"


def formula_key(x: str) -> str:
    t = f"lower({x})"
    rules = [*((k, (a,)) for k, aliases in L.FORMULA_ALIASES for a in aliases), *L.FORMULA_FALLBACKS]
    return "case " + " ".join(f"when {' and '.join(f'contains({t}, {q(w)})' for w in words)} then {q(k)}" for k, words in rules) + " end"


def parameter(x: str, name: str) -> str:
    return f"nullif(regexp_extract(replace(lower({x}), ',', '.'), {q(calculation.parameter_pattern(name))}, 1), '')::double"


def pattern(x: str) -> str:
    words = f"string_split_regex(lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g')), '{WS}+')"
    return f"array_to_string((list_filter({words}, lambda w: length(w) > 2))[1:8], ' ')"


HITS = """hits as (select * from (select r.*, q.query, q.query_type, row_number() over (partition by r.query_id, r.rank order by r.result_id) as n
  from search_results r join queries q using (query_id)) where n = 1)"""
CHUNKS = f"""chunks as (select parsed_id, chunk_id, doc_name, text from (select parsed_id, doc_name, c.chunk_id as chunk_id, {strip('c.text')} as text
  from (select parsed_id, doc_name, unnest(chunks) as c from parsed_documents)) where text <> '')"""
TERMS = f"""toks as (select parsed_id, chunk_id, regexp_extract_all(lower(text), '{TOKEN}') as t from chunks),
terms as (select parsed_id, chunk_id, term, count(*) as tf from (
  select parsed_id, chunk_id, unnest(t) as term from toks
  union all select parsed_id, chunk_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) from toks) group by all),
vocab as (select term, count(*) as df, sum(tf)::bigint as ctf from terms group by term order by ctf desc, term limit {SEARCH.vocabulary}),
idf as (select term, df, ctf, ln((1 + (select count(*) from chunks)) / (1 + df)) + 1 as idf from vocab)"""
_ASKED = f"(select query_id, query from queries where {_STEP} and {strip('query')} <> '')"


def lexical(asked: str) -> str:
    """The lexical score of every chunk that shares a term with a row (query_id, query) of `asked`."""
    return f"""raw as (select parsed_id, chunk_id, term, tf * idf as w from terms join idf using (term)),
post as (select parsed_id, chunk_id, term, w / sqrt(sum(w * w) over (partition by parsed_id, chunk_id)) as w from raw),
qt as (select query_id, regexp_extract_all(lower(query), '{TOKEN}') as t from {asked}),
qterms as (select query_id, term, count(*) as tf from (select query_id, unnest(t) as term from qt
  union all select query_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) from qt) group by all),
qraw as (select query_id, term, tf * idf as w from qterms join idf using (term)),
qw as (select query_id, term, w / sqrt(sum(w * w) over (partition by query_id)) as qw from qraw),
lex as (select query_id, parsed_id, chunk_id, sum(w * qw) as lexical from post join qw using (term) group by all)"""


LEXICAL = lexical(_ASKED)
USABLE = """usable as (select * from (select vec_id, parsed_id, chunk_id, list_transform(vec, lambda x: x::double) as v from chunk_vectors where vec is not null)
  where len(list_filter(v, lambda x: x is null or isnan(x))) = 0 and list_sum(list_transform(v, lambda x: x * x)) > 0)"""
_COS = "list_dot_product(v, qv) / sqrt(list_dot_product(v, v))"


def ranked(source: str, score: str, keys: str) -> str:
    return f"""select * from (select *, row_number() over (partition by query_id order by {score} desc, {keys}) as rank
  from (select * replace (round({score} + 1e-9, 6) as {score}) from {source}) where {score} >= {SEARCH.min_score}) where rank <= {SEARCH.top_k}"""


def boosted() -> str:
    name, low = "lower(coalesce(doc_name, ''))", "lower(coalesce(text, ''))"
    codes, refs = f"regexp_extract_all(query, '{_CODE}')", f"regexp_extract_all(query, '{_REF}')"
    return (
        f"coalesce(score, 0) + case when len(list_filter({codes}, lambda c: contains({name}, lower(c)) or contains({low}, lower(c)))) > 0 then 0.35e0 else 0e0 end "
        f"+ case when len(list_filter({refs}, lambda r: contains({low}, lower(r)))) > 0 then 0.2e0 else 0e0 end "
        f"+ least(0.25e0, len(list_filter(({domain_terms('query')})[1:8], lambda t: contains({low}, t))) * 0.03e0)"
    )


_WIDE = "'\\s{2,}'"


def _cells(x: str) -> str:
    """The cells of a line that is not a pipe line."""
    return f"case when contains({x}, chr(9)) then list_transform(string_split({x}, chr(9)), lambda c: {strip('c')}) else list_transform(string_split_regex({strip(x)}, {_WIDE}), lambda c: {strip('c')}) end"


def _lines(name: str, src: str, where: str) -> str:
    return f"{name} as (select id, generate_subscripts(a, 1) - 1 as i, unnest(a) as line from (select id, string_split(text, chr(10)) as a from {src} where text is not null and {where}))"


def pipes(src: str) -> str:
    return f"""{_lines('l', src, "contains(text, '|')")},
hit as (select *, i - row_number() over (partition by id order by i) as island from l where len(regexp_extract_all(line, '\\|')) >= 2),
pipes as (select id, min(i) as start, string_agg(line, chr(10) order by i) as raw_text, count(*) as n,
  list(list_transform(string_split(regexp_replace({strip('line')}, '^\\||\\|$', '', 'g'), '|'), lambda c: {strip('c')}) order by i) as rows from hit group by id, island),
ptab as (select id, start, raw_text, list_filter(rows, lambda r: len(list_filter(r, lambda c: c <> '')) > 0 and len(list_filter(r, lambda c: not regexp_full_match(c, '-+'))) > 0) as rows from pipes)"""


def aligned(src: str) -> str:
    return f"""{_lines('al', src, "true")},
ah as (select *, i - row_number() over (partition by id order by i) as island from al where regexp_matches(line, '[0-9]') and len(string_split_regex({strip('line')}, {_WIDE})) >= 3),
atab as (select id, min(i) as start, string_agg(line, chr(10) order by i) as raw_text, list({_cells('line')} order by i) as rows from ah group by id, island having count(*) >= 3)"""


def marked(src: str) -> str:
    return f"""{_lines('ml', src, f"contains(text, {q(L.TABLE_MARKER)})")},
mm as (select *, contains(line, {q(L.TABLE_MARKER)}) as m, {strip('line')} = '' as blank, lag(line) over (partition by id order by i) as prev from ml),
mi as (select *, max(case when m then i end) over (partition by id order by i) as island from mm),
mb as (select *, sum(blank::int) over (partition by id, island order by i) as gap, max(blank::int) over (partition by id, island) as ended, max(island) over (partition by id) as last from mi where island is not null),
mg as (select id, island, min(i) as start, list({strip('line')} order by i) as lines from mb where not m and gap = 0 and (ended = 1 or island = last) group by id, island),
mh as (select id, i as island, case when i > 0 and length({strip('prev')}) < 100 then {strip('prev')} end as head from mi where m),
mtab as (select id, start, coalesce(head, 'Таблица ' || (1 + coalesce(sum((len(lines) >= 3)::int) over (partition by id order by start rows between unbounded preceding and 1 preceding), 0))::bigint) as title,
  array_to_string(lines, chr(10)) as raw_text, list_transform(lines, lambda x: {_cells('x')}) as rows from mg join mh using (id, island))"""


_KEY = any_of("lower(line)", L.TABLE_KEYWORDS)


def keyed(src: str) -> str:
    return f"""kl as (select id, generate_subscripts(a, 1) - 1 as i, unnest(a) as raw from (select id, string_split(text, chr(10)) as a from {src} where text is not null)),
kt as (select id, i, {strip('raw')} as line from kl),
kk as (select *, {_KEY} as key from kt),
ki as (select *, max(case when key then i end) over (partition by id order by i) as island from kk),
kb as (select *, case when key then 0 when line = '' or (not regexp_matches(line, '\\p{{Nd}}') and not (length(line) > 50 and i - island < 5)) then 1 else 0 end as bad from ki where island is not null),
kc as (select *, sum(bad) over (partition by id, island order by i) as gap,
  max(case when key and contains(line, ':') then line end) over (partition by id, island) as title from kb),
ktab as (select id, min(i) as start, max(title) as title, string_agg(line, chr(10) order by i) as raw_text, list(line order by i) as lines, count(*) as n
  from kc where title is not null and not key and gap = 0 group by id, island having count(*) >= 2)"""


def mined(src: str) -> str:
    """The tables of the texts of `src` (id, text, source) from all four extractors, as tabs."""
    return f"""{pipes(src)}, {keyed(src)}, {aligned(src)}, {marked(src)},
found as (select id, 'pipe' as kind, start, null as title, raw_text, rows, 0.85e0 as confidence from ptab
  union all select id, 'keyword', start, title, raw_text, list_transform(lines, lambda x: {_cells('x')}), 0.6e0 from ktab
  union all select id, 'aligned', start, null, raw_text, rows, 0.7e0 from atab union all select id, 'marker', start, title, raw_text, rows, 0.95e0 from mtab),
once as (select *, row_number() over (partition by id, left(raw_text, 200) order by confidence desc, start, kind) as r from found),
tabs as (select id, kind, start, case when kind in ('pipe', 'aligned') then 'Таблица из ' || coalesce(source, '') else title end as title, raw_text, rows, confidence, table_no
  from (select once.*, source, row_number() over (partition by id order by confidence desc, start, kind) as table_no from once join (select distinct id, source from {src}) using (id) where r = 1 and len(rows) >= 3) where table_no <= 10)"""


_DOCUMENTS = "(select parsed_id as id, text, doc_name as source from parsed_documents)"
PIPES, KEYWORDS = pipes(_DOCUMENTS), keyed(_DOCUMENTS)
_ROWS = """trows as (select id, table_no, generate_subscripts(rows, 1) - 1 as row_no, unnest(rows) as row from tabs),
cells as (select id, table_no, row_no, array_to_string(row, ' ') as row_text, generate_subscripts(row, 1) - 1 as col_no, unnest(row) as cell from trows where row_no > 0)"""
CELLS = f"{mined(_DOCUMENTS)}, {_ROWS}"


def values(rows: tuple[tuple[int, str], ...]) -> str:
    return "(select * from (values " + ", ".join(f"({i}::bigint, {q(x)}, 'd')" for i, x in rows) + ") as t(id, text, source))"


_ITEMS = "(select pattern, query_type, item, min(row(seq, pos)) as place from {src} where item is not null and item <> '' group by all)"
MEMORY = f"""{HITS},
src as (select query_id, list(doc_name order by rank) as s from (select query_id, doc_name, min(rank) as rank from hits where doc_name is not null group by all) group by query_id),
ev as (select * from (select q.query_id as seq, coalesce(q.query_type, 'search') as query_type, q.asked_at as used_at, {pattern('q.query')} as pattern,
  list_transform(regexp_extract_all(q.query, '{KEYWORD}'), lambda w: lower(w)) as k, src.s from queries q join src using (query_id) where q.query is not null) where pattern <> ''),
heads as (select pattern, query_type, count(*) as success_count, min(seq) as first_seq, max(used_at) as last_used from ev group by all order by first_seq desc, pattern, query_type limit 300),
mine as (select ev.*, first_seq from ev join heads using (pattern, query_type)),
xk as (select pattern, query_type, seq, generate_subscripts(a, 1) as pos, unnest(a) as item from (select *, case when seq = first_seq then k[1:10] else k end as a from mine)),
xs as (select pattern, query_type, seq, generate_subscripts(a, 1) as pos, unnest(a) as item from (select *, s[1:8] as a from mine)),
xb as (select pattern, query_type, seq, generate_subscripts(a, 1) as pos, unnest(a) as item from (select *, k[1:6] as a from mine)),
{", ".join(f'''{o} as (select pattern, query_type, list(item order by r) as items from (select *, row_number() over (partition by pattern, query_type order by place, item) as r
  from {_ITEMS.format(src=i)}) where r <= {cap} group by all)''' for o, i, cap in (('mk', 'xk', 15), ('ms', 'xs', 10), ('mb', 'xb', 10)))},
mem as (select heads.*, coalesce(mk.items, []) as keywords, coalesce(ms.items, []) as sources, coalesce(mb.items, []) as boost_terms
  from heads left join mk using (pattern, query_type) left join ms using (pattern, query_type) left join mb using (pattern, query_type))"""


def sql() -> dict[str, str]:
    gsop, out = "(20 - t_ot) * z_ot", {}
    out["scan_counts_by_source"] = "select source, count(*) as documents, count(text) as with_text, sum(n_chars)::bigint as chars from documents group by source"
    out["docs_per_filetype"] = "select filetype, count(*) as documents from parsed_documents group by filetype"
    out["supported_files"] = "select parsed_id, lower(regexp_extract(filepath, '\\.[^.]+$', 0)) as suffix, lower(regexp_extract(filepath, '\\.[^.]+$', 0)) in ('.pdf', '.docx', '.doc', '.rtf') as supported from parsed_documents where filepath is not null"
    out["normalize_text"] = f"select doc_id, {normalize('text')} as text from documents where text is not null"
    out["paragraph_split"] = (
        f"select doc_id, (generate_subscripts(p, 1) - 1)::bigint as para_no, unnest(p) as text from (select doc_id, list_filter(list_transform(string_split_regex({normalize('text')}, '\\n{WS}*\\n'), lambda x: {strip('x')}), lambda x: x <> '') as p from documents)"
    )
    out["sentence_split"] = f"select doc_id, (generate_subscripts(s, 1) - 1)::bigint as pos, unnest(s) as sentence from (select doc_id, {sentences('text')} as s from documents where text is not null)"
    tail = strip("right(text, 200)")
    out["smart_overlaps"] = (
        f"select doc_id, case when p > 0 and p < length(s) // 2 then {strip('substr(s, p + 2)')} else s end as overlap from (select doc_id, s, instr(s, ' ') - 1 as p from (select doc_id, {tail} as s from documents where text is not null))"
    )
    out["formula_mentions"] = f"""with m as (select doc_id, generate_subscripts(a, 1) as pos, unnest(a) as raw from (select doc_id, list_transform(regexp_extract_all(text, '{FORMULA}'), lambda x: {strip('x')}) as a from documents)),
      d as (select doc_id, raw, min(pos) as pos from m where length(raw) >= 4 group by all), r as (select doc_id, raw, row_number() over (partition by doc_id order by pos) - 1 as pos from d)
      select doc_id, pos::bigint as pos, raw, array_to_string(list_sort(list_distinct(regexp_extract_all(raw, '{VARIABLE}'))), ',') as variables from r where pos < 20"""
    out["agent_formulas"] = f"""with f as (select doc_id, list_transform(list_filter(regexp_extract_all(text, {q(AGENT_FORMULA)}), lambda x: length(x) > 3), lambda x: {strip('x')}) as a,
      list_transform(list_filter(regexp_extract_all(text, {q(BRACKET_FORMULA)}, 1), lambda x: length(x) > 3), lambda x: '(' || x || ')') as b from documents)
      select distinct doc_id, unnest(list_concat(a, b)) as raw from f where a is not null"""
    out["table_like_flag"] = f"select doc_id, {table_like('text')} as flag from documents where text is not null"
    words = f"len(list_filter(string_split_regex(t, '{WS}+'), lambda w: w <> ''))"
    out["doc_metadata"] = f"""select doc_id, length(t)::bigint as char_count, {words}::bigint as word_count, len(list_filter({sentences('t')}, lambda s: {strip('s')} <> ''))::bigint as sentence_count,
      len(list_filter(regexp_extract_all(t, '{FORMULA}'), lambda x: length({strip('x')}) >= 4)) > 0 as has_formulas, {table_like('t')} as has_table_like_content from (select doc_id, coalesce(text, '') as t from documents)"""
    full = f"len(list_filter(c, lambda x: {strip('x.text')} <> ''))"
    out["index_diagnostics"] = f"""select count(*) as documents_total, count_if(f > 0)::bigint as with_chunks, sum(f)::bigint as chunks_total, sum(n - f)::bigint as skipped_empty, ceil(sum(f) / 32.0)::bigint as batches
      from (select len(c) as n, {full} as f from (select coalesce(chunks, []) as c from parsed_documents))"""
    out["token_stats"] = f"select token, sum(n)::bigint as tf, count(*) as df from (select doc_id, token, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(replace(text, 'İ', 'i' || chr(775))), '{TOKEN}')) as token from documents) group by all) group by token"
    out["term_vocabulary"] = f"with {CHUNKS}, {TERMS} select term, df, ctf from vocab"
    out["idf_table"] = f"with {CHUNKS}, {TERMS} select term, df, round(idf, 6) as idf from idf"
    out["lexical_search"] = f"with {CHUNKS}, {TERMS}, {LEXICAL} select query_id, rank, parsed_id, chunk_id, lexical from ({ranked('lex', 'lexical', 'parsed_id, chunk_id')})"
    out["semantic_search"] = f"""with {USABLE}, qs as (select query_id, list_transform(qvec, lambda x: x::double) as qv from queries where {_STEP}),
      s as (select query_id, vec_id, round({_COS} / sqrt(list_dot_product(qv, qv)), 6) as semantic from qs, usable)
      select query_id, rank, vec_id, semantic from (select *, row_number() over (partition by query_id order by semantic desc, vec_id) as rank from s) where rank <= {SEARCH.top_k}"""
    # every chunk against every question: a missing side counts 0
    out["hybrid_search"] = f"""with {CHUNKS}, {TERMS}, {LEXICAL}, {USABLE}, qs as (select query_id, list_transform(qvec, lambda x: x::double) as qv from queries where {_STEP} and {strip('query')} <> ''),
      sem as (select query_id, parsed_id, chunk_id, max({_COS}) as semantic from usable, qs group by all),
      h as (select query_id, parsed_id, chunk_id, {SEARCH.semantic_weight}e0 * coalesce(semantic, 0) + {SEARCH.lexical_weight}e0 * coalesce(lexical, 0) as score
        from (select distinct parsed_id, chunk_id from chunks) cross join (select query_id from qs) left join sem using (query_id, parsed_id, chunk_id) left join lex using (query_id, parsed_id, chunk_id))
      select query_id, rank, parsed_id, chunk_id, score from ({ranked('h', 'score', 'parsed_id, chunk_id')})"""
    out["hybrid_rank"] = f"""with {HITS}, h as (select query_id, result_id, {SEARCH.semantic_weight}e0 * coalesce(semantic_score, 0) + {SEARCH.lexical_weight}e0 * coalesce(lexical_score, 0) as score from hits)
      select query_id, rank, result_id, score from ({ranked('h', 'score', 'result_id')})"""
    best = f"with {HITS}, b as (select query_id, doc_name, min(row(rank, result_id)) as b, arg_min(score, row(rank, result_id)) as score from hits group by all), o as (select *, row_number() over (partition by query_id order by b) as ord from b)"
    out["answer_sources"] = f"{best} select query_id, ord, doc_name, score from o where ord <= 5"
    out["answer_context"] = f"with {HITS} select query_id, string_agg('[' || rank || '] ' || coalesce(doc_name, '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by rank) as context from hits group by query_id"
    answers = f"""x as (select query_id, rank, {strip('text')} as t, row_number() over (partition by query_id order by rank) as r from hits where {strip('text')} <> ''),
      y as (select query_id, regexp_replace(string_agg(t, chr(10) || chr(10) order by r), '\\n{{3,}}', chr(10) || chr(10), 'g') as a from x where r <= 3 group by query_id),
      ans as (select query_id, case when length(a) > 1800 then regexp_replace(left(a, 1800), ' [^ ]*$', '') || '...' else a end as answer from y)"""
    out["extractive_answer"] = f"with {HITS}, {answers} select query_id, answer from ans"
    prefix = "^(?:" + "|".join(L.DEFINITION_PREFIXES) + ")"
    out["find_definition"] = f"""with {CHUNKS}, t as (select distinct term from (select trim(regexp_replace(lower({strip('query')}), {q(prefix)}, ''), {q(" ?!.,:;\"'«»()[]")}) as term
        from queries where {starts(f"lower({strip('query')})", L.DEFINITION_PREFIXES)}) where term <> ''),
      s as (select parsed_id, chunk_id, generate_subscripts(a, 1) as pos, unnest(a) as sentence from (select parsed_id, chunk_id, {sentences('text')} as a from chunks)),
      h as (select term, {strip('sentence')} as definition, parsed_id, chunk_id, row_number() over (partition by term order by length(sentence), parsed_id, chunk_id, pos) as r
        from t join s on contains(lower(sentence), term) where length(sentence) < 100)
      select term, definition, parsed_id, chunk_id from h where r = 1"""
    out["report_rows"] = f"""{best}, {answers}, body as (select query_id, 'answer' as section, (generate_subscripts(a, 1) - 1)::bigint as ord, unnest(a) as line from (select query_id, string_split(replace(answer, '*', ''), chr(10)) as a from ans))
      select * from body where {strip('line')} <> '' union all select query_id, 'source', ord, doc_name from o where ord <= 5"""
    out["pipe_tables"] = f"with {PIPES} select id, start::bigint as start, (len(rows) - 1)::bigint as data_rows, raw_text from ptab where len(rows) >= 3"
    out["keyword_tables"] = f"with {KEYWORDS} select id, start::bigint as start, title, raw_text from ktab"
    out["extract_tables"] = f"with {CELLS} select id, table_no, kind, title, (len(rows) - 1)::bigint as data_rows, confidence from tabs"
    out["table_cells"] = f"with {CELLS} select id, table_no, row_no::bigint as row_no, col_no::bigint as col_no, cell from cells"
    number = lambda i: f"replace(regexp_extract_all(row_text, '-?\\d+[.,]?\\d*')[{i}], ',', '.')::double"
    out["gsop_from_table"] = f"""with {CELLS}, h as (select name as city, id, row_text, row_number() over (partition by name order by id, table_no, row_no, col_no) as r from cells join cities on contains(lower(cell), lower(name))),
      c as (select city, id as parsed_id, {number(1)} as t_ot, trunc({number(2)})::bigint as z_ot from h where r = 1)
      select city, parsed_id, t_ot, z_ot, round({gsop}, 6) as gsop, round(0.335e0 * 100 * (20 - round(t_ot, 1)), 6) as ventilation, round(50 * (20 - round(t_ot, 1)) / 3.2e0, 6) as heat_loss from c"""
    out["formula_gsop"] = f"select name, round({gsop}, 6) as gsop from cities"
    out["formula_ventilation"] = "select name, coalesce(t_n, t_ot - 20) as t_n, round(0.335e0 * 100 * (20 - coalesce(t_n, t_ot - 20)), 6) as heat from cities"
    out["formula_heat_loss"] = "select name, round(50 * (20 - coalesce(t_n, t_ot - 20)) / 3.2e0, 6) as loss from cities"
    out["formula_layer_resistance"] = "select material_id, round(0.1e0 / nullif(lambda_value, 0), 6) as resistance from materials"
    out["formula_insulation_thickness"] = "select material_id, round(3.2e0 * lambda_value, 6) as thickness from materials"
    out["formula_heat_flux"] = "select l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity, 0) + 1e-9, 6) as flux from lineitem"
    out["insulation_calculator"] = """select material_id, round(mm, 6) as delta_mm, round_even(mm / 10, 0) * 10 as recommended_mm,
      case when mm < 20 then 'below minimum' when mm > 320 then 'above maximum' when mm > 200 then 'several layers' else 'ok' end as verdict
      from (select material_id, lambda_value * (130e0 / 40 - 0.1e0) * 1000 as mm from materials where lambda_value is not null)"""
    out["extract_params"] = "select query_id, " + ", ".join(f"{parameter('query', p)} as \"p_{p}\"" for p in calculation.PARAMETERS) + " from queries"
    out["detect_formula"] = f"select * from (select query_id, {formula_key('query')} as formula from queries) where formula is not null"
    out["detect_city"] = "select query_id, city from (select query_id, name as city, row_number() over (partition by query_id order by -length(name), name) as r from queries join cities on contains(lower(query), lower(name))) where r = 1"
    needed = {k: n for k, _, _, _, n in L.FORMULAS}
    value = {
        "gsop": "(t_v - t_ot) * z_ot", "ventilation_heat": "0.335e0 * L * (t_v - t_n)", "heat_loss": "A * delta_t / nullif(R, 0)",
        "thermal_resistance_layer": "delta / nullif(lambda_value, 0)", "required_insulation_thickness": "R_tr * lambda_value", "pipe_surface_heat_flux": "Q / nullif(L, 0)",
    }
    missing = "case formula " + " ".join("when %s then concat_ws(',', %s)" % (q(k), ", ".join(f"case when {p} is null then {q(p)} end" for p in n)) for k, n in needed.items()) + " end"
    result = "case formula " + " ".join(f"when {q(k)} then {v}" for k, v in value.items()) + " end"
    out["calculation_answers"] = f"""with p as (select query_id, {formula_key('query')} as formula, {', '.join(f"{parameter('query', p)} as {p}" for p in calculation.PARAMETERS)} from queries),
      r as (select query_id, formula, {missing} as missing, {result} as result from p where formula is not null)
      select query_id, formula, missing, round(result, 6) as result, case when missing <> '' then 'missing' when result is null then 'error' else 'ok' end as status,
      case when missing <> '' then 0.3e0 when result is null then 0e0 else 0.9e0 end as confidence from r"""
    phrases = "(select * from (values " + ", ".join(f"({i + 1}::bigint, {q(x)})" for i, x in enumerate(calculation.CLIMATE_PHRASES)) + ") as t(query_id, query))"
    number = lambda i: f"try_cast(replace(regexp_extract_all(row_text, '-?\\d+[.,]?\\d*')[{i}], ',', '.') as double)"
    flow = (
        "coalesce(replace(nullif(regexp_extract(lower(query), '(\\d+[.,]?\\d*)\\s*м³/ч', 1), ''), ',', '.')::double, replace(nullif(regexp_extract(lower(query), 'расход\\s*(\\d+[.,]?\\d*)', 1), ''), ',', '.')::double, "
        + parameter("query", "L") + ")"
    )
    low = "lower(query)"
    air, wall = any_of(low, ("вентиляц", "расход теплоты", "нагрев воздуха")), any_of(low, ("теплопотер", "потери тепла", "ограждени"))
    out["calculation_driver"] = f"""with {CHUNKS}, {TERMS}, {lexical(phrases)},
      lr as (select query_id, parsed_id, chunk_id, row_number() over (partition by query_id order by round(lexical + 1e-9, 6) desc, parsed_id, chunk_id) as rank from lex where round(lexical + 1e-9, 6) >= {SEARCH.min_score}),
      hits3 as (select query_id, rank, parsed_id * 1000000 + chunk_id as id, doc_name, text from lr join chunks using (parsed_id, chunk_id) where rank <= 3), texts as (select distinct id, text, doc_name as source from hits3),
      {mined('texts')}, ht as (select query_id, rank as hit, tabs.*, doc_name, row_number() over (partition by query_id, doc_name, left(raw_text, 200) order by rank, id, table_no) as n from hits3 join tabs using (id)),
      hu as (select *, row_number() over (partition by query_id order by hit, id, table_no) as place from ht where n = 1 and query_id = (select min(query_id) from ht)),
      hr as (select hit, place, doc_name, generate_subscripts(rows, 1) - 1 as row_no, unnest(rows) as row from hu),
      cc as (select name as city, doc_name as source, array_to_string(row, ' ') as row_text, row_number() over (partition by name order by len(list_filter(row, lambda c: contains(lower(c), lower(name)))) = 0, hit, place, row_no) as r
        from hr join cities on contains(lower(array_to_string(row, ' ')), lower(name)) where row_no > 0),
      cl as (select city, source, {number(1)} as t_ot, trunc({number(2)})::bigint as z_ot, true as there from cc where r = 1),
      qc as (select query_id, query, city from (select query_id, query, name as city, row_number() over (partition by query_id order by -length(name), name) as r from queries join cities on contains(lower(query), lower(name))) where r = 1),
      pl as (select query_id, city, {flow} as flow, {parameter('query', 'A')} as area, {parameter('query', 'R')} as res,
        case when {air} then case when {flow} is not null then 'ventilation' end when {wall} then case when {parameter('query', 'A')} is not null and {parameter('query', 'R')} is not null then 'heat_loss' end else 'gsop' end as plan from qc),
      fo as (select pl.*, t_ot, z_ot, case when (select count(*) from hu) = 0 then 'no_tables' when there is null then 'city_not_found' when t_ot is null or z_ot is null then 'no_numbers' else 'ok' end as found from pl left join cl using (city) where plan is not null),
      vv as (select *, case when found = 'ok' then case plan when 'gsop' then (20 - t_ot) * z_ot when 'ventilation' then 0.335e0 * flow * (20 - round(t_ot, 1)) else area * (20 - round(t_ot, 1)) / nullif(res, 0) end end as value from fo),
      tt as (select query_id, case when plan = 'gsop' or found = 'ok' then case when found = 'ok' and value is null then 'error' else found end else 'no_climate' end as outcome, plan, value from vv),
      pp as (select query_id, {formula_key('query')} as formula, {', '.join(f"{parameter('query', p)} as {p}" for p in calculation.PARAMETERS)} from queries),
      rr as (select query_id, formula, {missing} as missing, {result} as result from pp where formula is not null),
      zz as (select rr.*, outcome, plan, value, outcome is not null and formula in ('gsop', 'ventilation_heat', 'heat_loss') as served from rr left join tt using (query_id))
      select query_id, formula, case when served then 'table' else 'parameters' end as path, case when served then outcome when missing <> '' then 'missing' when result is null then 'error' else 'ok' end as status,
        round(case when served then value else result end, 6) as result, case when served then case when outcome = 'ok' then case plan when 'gsop' then 0.9e0 else 0.85e0 end when outcome = 'no_numbers' then 0.2e0 else 0e0 end
        when missing <> '' then 0.3e0 when result is null then 0e0 else 0.9e0 end as confidence from zz"""
    for name, fixture, body in (("marker_tables", fixtures.MARKED, marked), ("aligned_tables", fixtures.ALIGNED, aligned)):
        out[name] = f"with {body(values(fixture))} select id, start::bigint as start, {'title' if name == 'marker_tables' else 'null::varchar as title'}, raw_text, len(rows)::bigint as n from {'mtab' if name == 'marker_tables' else 'atab'}"
    out["fixture_tables"] = f"with {mined(values(fixtures.MARKED + fixtures.ALIGNED + fixtures.MIXED))} select id, table_no, kind, title, (len(rows) - 1)::bigint as data_rows, confidence, list_transform(rows, lambda r: array_to_string(r, '¦'))[1] as head from tabs"
    out["hit_tables"] = f"""with {HITS}, top3 as (select query_id, rank, result_id as id, coalesce(doc_name, '') as doc_name, text from hits where rank <= 3), texts as (select id, text, doc_name as source from top3), {mined('texts')},
      ht as (select query_id, rank as hit, tabs.*, doc_name, row_number() over (partition by query_id, doc_name, left(raw_text, 200) order by rank, id, table_no) as n from top3 join tabs using (id))
      select query_id, hit, doc_name as source, row_number() over (partition by query_id order by hit, id, table_no) as place, kind, title, (len(rows) - 1)::bigint as data_rows, confidence from ht where n = 1"""
    size, overlap, least = CHUNKING.size, CHUNKING.overlap, CHUNKING.least
    cut = f"case when a + {size} < n then case when strpos(reverse(substr(t, a + 1, {size})), ' ') > 0 and a + {size} - strpos(reverse(substr(t, a + 1, {size})), ' ') > a + {least} then a + {size} - strpos(reverse(substr(t, a + 1, {size})), ' ') else a + {size} end else n end"
    out["hard_windows"] = f"""with recursive d as (select doc_id, {normalize('text')} as t from documents where text is not null),
      w as (select doc_id, t, length(t) as n, 0::bigint as a, 0::bigint as k from d union all select doc_id, t, n, greatest(({cut}) - {overlap}, a + 1), k + 1 from w where ({cut}) < n),
      p as (select doc_id, k, {strip(f'substr(t, a + 1, ({cut}) - a)')} as piece from w)
      select doc_id, (row_number() over (partition by doc_id order by k) - 1)::bigint as piece_no, piece from p where piece <> ''"""
    out["classify_queries"] = f"select query_id, {query_type('query')} as kind, {route('query')} as route from queries where query is not null"
    out["query_entities"] = f"""select query_id, array_to_string(regexp_extract_all(query, '{_CODE}'), '|') as document_codes, array_to_string(regexp_extract_all(query, '{_REF}'), '|') as section_refs,
      array_to_string({domain_terms('query')}, '|') as domain_terms, len({numbers('query')})::bigint as numeric_values from queries where query is not null"""
    join = lambda a, n: f"trim(array_to_string(list_concat({a}[1:2], terms[1:{n}]), ' '))"
    out["expand_queries"] = f"""with e as (select query_id, query, regexp_extract_all(query, '{_CODE}') as codes, regexp_extract_all(query, '{_REF}') as refs, {domain_terms('query')} as terms from queries where query is not null),
      v as (select query_id, unnest([1, 2, 3, 4]) as k, unnest([{strip('query')}, case when len(codes) > 0 then {join('codes', 4)} end, case when len(refs) > 0 then {join('refs', 4)} end,
        case when len(terms) > 0 then trim(array_to_string(terms[1:8], ' ')) end]) as variant from e),
      d as (select query_id, min(k) as k, arg_min(variant, k) as variant from v where variant is not null and variant <> '' group by query_id, lower(variant))
      select query_id, (row_number() over (partition by query_id order by k) - 1)::bigint as ord, variant from d"""
    out["rerank_hits"] = f"""with {HITS}, o as (select *, row_number() over (partition by query_id, doc_name, left(text, 250) order by rank, chunk_id) as k from hits),
      b as (select *, round({boosted()} + 1e-9, 6) as boosted from o where k = 1), r as (select *, row_number() over (partition by query_id order by boosted desc, rank, doc_name, chunk_id) as new_rank from b)
      select query_id, new_rank, result_id, boosted from r where new_rank <= case {query_type('query')} when 'calculation' then 8 when 'regulatory' then 14 else 12 end"""
    read = {n: f"try_cast(replace(nullif(regexp_extract(text, {q(p)}, 1), ''), ',', '.') as double)" for n, p in CONTEXT.items()}
    read["temperature"] = f"coalesce({read['temperature']}, ({numbers('query')})[1])"
    read["flow"] = f"coalesce({read['flow']}, ({numbers('query')})[2])"
    kind_k = "case kind when 'calculation' then 8 when 'regulatory' then 14 else 12 end"
    preferred = "case when len(list_filter(coalesce(sources, []), lambda s: contains(lower(coalesce(doc_name, '')), lower(s)))) > 0 then 0.2e0 else 0e0 end"
    out["agent_search"] = f"""with {MEMORY}, asked as (select query_id, query, list_transform(qvec, lambda x: x::double) as qv, {query_type('query')} as kind, {pattern('query')} as p from queries where {_STEP} and {strip('query')} <> ''),
      bh as (select query_id, mem.*, row_number() over (partition by query_id order by success_count desc, last_used desc, pattern) as r from asked join mem on mem.query_type = asked.kind
        where p <> '' and (len(list_intersect(string_split(p, ' '), string_split(pattern, ' '))) >= 2 or p = pattern)),
      bi as (select query_id, r, 'source' as boost, generate_subscripts(sources, 1) as pos, unnest(sources) as item from bh union all select query_id, r, 'term', generate_subscripts(boost_terms, 1), unnest(boost_terms) from bh),
      bf as (select query_id, boost, item, min(row(r, pos)) as place from bi group by all), bo as (select *, row_number() over (partition by query_id, boost order by place) as o from bf),
      bs as (select query_id, list(item order by o) filter (where boost = 'source') as sources, list(item order by o) filter (where boost = 'term') as words from bo where o <= 8 group by query_id),
      ae as (select asked.*, coalesce(sources, []) as sources, coalesce(words, []) as words, regexp_extract_all(query, '{_CODE}') as codes, regexp_extract_all(query, '{_REF}') as refs, {domain_terms('query')} as terms from asked left join bs using (query_id)),
      av as (select query_id, unnest([1, 2, 3, 4, 5]) as k, unnest([{strip('query')}, case when len(codes) > 0 then {join('codes', 4)} end, case when len(refs) > 0 then {join('refs', 4)} end,
        case when len(terms) > 0 then trim(array_to_string(terms[1:8], ' ')) end, case when len(words) > 0 then trim(array_to_string(list_concat(terms[1:5], words[1:3]), ' ')) end]) as variant from ae),
      ad as (select query_id, min(k) as k, arg_min(variant, k) as variant from av where variant is not null and variant <> '' group by query_id, lower(variant)),
      sought as (select * from (select query_id, variant, row_number() over (partition by query_id order by k) - 1 as ord from ad) where ord < 4),
      vq as (select query_id * 4 + ord as query_id, variant as query from sought),
      {CHUNKS}, {TERMS}, {lexical('vq')}, {USABLE},
      sem as (select query_id * 4 + ord as query_id, parsed_id, chunk_id, max({_COS}) as semantic from usable, (select query_id, ord, qv from sought join asked using (query_id)) group by all),
      h as (select query_id, parsed_id, chunk_id, {SEARCH.semantic_weight}e0 * coalesce(semantic, 0) + {SEARCH.lexical_weight}e0 * coalesce(lexical, 0) as score
        from (select distinct parsed_id, chunk_id from chunks) cross join (select query_id from vq) left join sem using (query_id, parsed_id, chunk_id) left join lex using (query_id, parsed_id, chunk_id)),
      hr as (select query_id // 4 as query_id, query_id % 4 as ord, parsed_id, chunk_id, round(score + 1e-9, 6) as score, row_number() over (partition by query_id order by round(score + 1e-9, 6) desc, parsed_id, chunk_id) as rank from h where round(score + 1e-9, 6) >= {SEARCH.min_score}),
      hk as (select hr.*, query, kind, sources, doc_name, text from hr join ae using (query_id) join chunks using (parsed_id, chunk_id) where rank <= {kind_k}),
      ho as (select * from (select *, row_number() over (partition by query_id, doc_name, left(text, 250) order by ord, rank, parsed_id, chunk_id) as n from hk) where n = 1),
      hb as (select * replace (round({boosted()} + {preferred} + 1e-9, 6) as score) from ho), hz as (select *, row_number() over (partition by query_id order by score desc, ord, rank, parsed_id, chunk_id) as place from hb)
      select query_id, kind, place::bigint as place, parsed_id, chunk_id, doc_name, score from hz where place <= {kind_k}"""
    out["context_params"] = f"""with {HITS}, p as (select query_id, any_value(query) as query, string_agg(coalesce(text, ''), chr(10) order by rank) filter (where rank <= 3) as text, avg((coalesce(score, 0) > 0.5)::int) as good from hits group by query_id)
      select query_id, {', '.join(f'{c} as {n}' for n, c in read.items())}, round(case when good > 0 then good else 0.5 end, 6) as confidence from p"""
    marks = "[" + ", ".join(q(m) for m in L.REGULATORY_MARKERS) + "]"
    out["regulatory_sentences"] = f"""with {CHUNKS}, s as (select parsed_id, chunk_id, {sentences('text')} as s, unnest({marks}) as marker from chunks),
      f as (select parsed_id, chunk_id, marker, list_filter(s, lambda x: contains(lower(x), marker)) as s from s) select parsed_id, chunk_id, marker, {strip('s[1]')} as sentence from f where len(s) > 0"""
    out["completeness_check"] = f"""with a as (select query_id, {query_type('query')} = 'calculation' as calc, {formula_key('query')} is not null as f, len({numbers('query')}) > 0 as p, length({strip('query')}) < 20 as short from queries where query is not null),
      n as (select query_id, (calc and not f) or short as needs_clarification, ((calc and not f)::int + (calc and not p)::int + (short and not (calc and not f))::int)::bigint as questions from a)
      select query_id, needs_clarification, questions, round(greatest(0e0, 1 - questions * 0.2e0), 6) as completeness from n"""
    out["memory_upsert"] = f"with {MEMORY} select pattern, query_type, success_count, first_seq, array_to_string(keywords, '|') as keywords, array_to_string(sources, '|') as sources, array_to_string(boost_terms, '|') as boost_terms from mem"
    out["memory_stats"] = f"with {MEMORY} select count(*) as records, count(distinct pattern) as patterns, round(coalesce(avg(success_count), 0), 6) as avg_success from mem"
    out["memory_top"] = f"with {MEMORY} select pattern, query_type, success_count from mem order by success_count desc, pattern, query_type limit 10"
    out["memory_boosts"] = f"""with {MEMORY}, a as (select * from (select query_id, coalesce(query_type, 'search') as query_type, {pattern('query')} as p from queries where {_STEP} and query is not null) where p <> ''),
      h as (select query_id, mem.*, row_number() over (partition by query_id order by success_count desc, last_used desc, pattern) as r from a join mem using (query_type)
        where len(list_intersect(string_split(p, ' '), string_split(pattern, ' '))) >= 2 or p = pattern),
      i as (select query_id, r, 'source' as kind, generate_subscripts(sources, 1) as pos, unnest(sources) as item from h union all select query_id, r, 'term', generate_subscripts(boost_terms, 1), unnest(boost_terms) from h),
      f as (select query_id, kind, item, min(row(r, pos)) as place from i group by all), o as (select *, row_number() over (partition by query_id, kind order by place) as ord from f)
      select query_id, kind, ord, item from o where ord <= 8"""
    out["glossary_lookup"] = f"""with g as (select lower(string_split(names, '; ')[1]) as entry, common_unit as definition from common_units),
      t as (select distinct term, lower({strip('term')}) as t from (select unnest(headers) as term from extracted_tables)), h as (select term, entry, definition, row_number() over (partition by term order by t <> entry, entry) as r
      from t join g on contains(t, entry) or contains(entry, t) where t <> '') select term, entry, definition from h where r = 1"""
    out["error_summary"] = "select event_type as type, count(*) as n, arg_max(event_id, row(ts, event_id)) as last_id, max(ts) as last_at from events group by event_type"
    turn = "string_split(regexp_replace(text, '\\n(user|assistant): ', chr(1) || '\\1: ', 'g'), chr(1))"
    out["chat_turns"] = f"""with t as (select doc_id, generate_subscripts(a, 1) - 1 as turn, unnest(a) as p from (select doc_id, {turn} as a from documents where regexp_matches(text, '^(?:user|assistant): ')))
      select doc_id, turn::bigint as turn, regexp_extract(p, '^(user|assistant): ', 1) as role, regexp_replace(p, '^(?:user|assistant): ', '') as content from t"""
    out["standards_mentioned"] = f"select doc_id, standard, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '{STANDARD}')) as standard from documents) group by all"
    long = f"length({strip("coalesce(text, '')")}) > 30"
    out["useful_chunks"] = f"""with {HITS}, u as (select query_id, result_id, {long} as good, max(({long})::int) over (partition by query_id) as any_good, row_number() over (partition by query_id order by rank, result_id) as place from hits)
      select query_id, result_id from u where good or (any_good = 0 and place <= 2)"""
    out["hit_formulas"] = f"""with {HITS}, f as (select query_id, rank, result_id, doc_name, generate_subscripts(a, 1) as pos, unnest(a) as raw from (select *, regexp_extract_all(text, '{FORMULA}')[1:3] as a from hits where rank <= 3)),
      r as (select *, row_number() over (partition by query_id, raw order by rank, result_id, pos) as k from f) select query_id, raw, doc_name as source from r where k = 1"""
    out["shortened_results"] = "select result_id, case when length(text) > 200 then left(text, 200) || '...' else text end as text from search_results where text is not null"
    out["formula_registry"] = "select * from (values " + ", ".join(f"({q(k)}, {q(n)}, {q(u)}, {q(src)}, {q(','.join(p))})" for k, n, u, src, p in L.FORMULAS) + ") as t(formula, name, unit, source, parameters)"
    out["prompts"] = f"""with {HITS}, c as (select query_id, any_value(query) as query, string_agg('[' || rank || '] ' || coalesce(doc_name, '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by rank) as context from hits group by query_id)
      select query_id, 'Вопрос: ' || coalesce(query, '') || chr(10) || chr(10) || 'Контекст:' || chr(10) || context || chr(10) || chr(10) || 'Ответ:' as prompt from c"""
    edges = f"e as (select distinct doc_name, unnest(regexp_extract_all(text, '{STANDARD}')) as standard from parsed_documents where doc_name is not null)"
    graph = f"{edges}, g as (select doc_name as node, 'document' as type, count(*) as degree from e group by doc_name union all select standard, 'standard', count(*) from e group by standard)"
    out["mention_graph"] = f"with {graph} select node, type, degree from g"
    out["graph_top_nodes"] = f"with {graph} select node, type, degree from g order by degree desc, node, type limit 10"
    out["graph_statistics"] = f"with {graph} select count(*) as nodes, (sum(degree) // 2)::bigint as edges, round(sum(degree) / (count(*) * (count(*) - 1))::double, 9) as density, max(degree) as top_degree from g"
    asked_terms = f"(select query_id, trim(regexp_replace(lower({strip('query')}), {q(prefix)}, ''), {q(TRIMMED)}) as term from queries where {starts(f"lower({strip('query')})", L.DEFINITION_PREFIXES)})"
    entries = "(values " + ", ".join(f"({i}, {', '.join(map(q, g))})" for i, g in enumerate(GLOSSARY)) + ") as g(ord, entry, definition, source, example)"
    out["quick_definitions"] = f"""with t as (select distinct term from {asked_terms} where term <> ''), h as (select *, row_number() over (partition by term order by term <> entry, ord) as r from t join {entries} on contains(term, entry) or contains(entry, term))
      select term, entry, definition, source, example from h where r = 1"""
    out["definition_fallback"] = f"""with {HITS}, t as (select * from {asked_terms} where term <> ''), h as (select query_id, term, rank, result_id, doc_name, list_filter({sentences('text')}, lambda s: contains(lower(s), term)) as s from hits join t using (query_id)),
      f as (select *, row_number() over (partition by query_id, term order by rank, result_id) as r from h where len(s) > 0) select query_id, term, {strip('s[1]')} as definition, doc_name as source from f where r = 1"""
    rows = ", ".join(f"({i}::bigint, {q(k)}, {q(m)})" for i, k, m in fixtures.ERRORS)
    module = "nullif(regexp_extract(message, " + q("'([^']+)'") + ", 1), '')"
    area = "case when contains(kind, 'FormulaEngine') or contains(lower(message), 'calculation') then 'calculation' when contains(kind, 'QASystem') or contains(lower(message), 'search') then 'search' when contains(kind, 'AgentLoop') then 'agent' else 'other' end"
    fill = lambda x, m="message": f"replace(replace({q(x)}, '{{lib}}', coalesce({module}, {q(UNNAMED_LIBRARY)})), '{{m}}', {m})"
    said = "case " + " ".join(f"when area = {q(a)} then {fill(x)}" for a, x in AREA_ERRORS) + " " + " ".join(f"when kind = {q(k)} then {fill(x)}" for k, x in ERRORS)
    said += f" else {fill(OTHER_ERROR, f'case when length(message) = 0 then {q(UNKNOWN_ERROR)} else message end')} end"
    out["error_messages"] = f"select id, {said} as user_message, area, {module} as module, kind in ({', '.join(map(q, L.CRITICAL_ERRORS))}) as critical from (select *, {area} as area from (values {rows}) as t(id, kind, message))"
    number_ = r"-?\d+(?:[.,]\d+)?"
    stems = "[" + ", ".join(map(q, MATERIALS)) + "]"
    section, thick = r"(?m)^[ \t]*(\d+(?:\.\d+)+)[. \t]", rf"({number_}\s?мм)(?:[^\p{{L}}²³]|$)"
    out["document_entities"] = f"""select distinct doc_id, kind, item from (select doc_id, 'standard' as kind, unnest(regexp_extract_all(text, '{STANDARD}')) as item from documents
      union all select doc_id, 'material', unnest(list_filter({stems}, lambda m: contains(lower(text), m))) from documents
      union all select doc_id, 'section', unnest(regexp_extract_all(text, '{section}', 1)) from documents
      union all select doc_id, 'temperature', unnest(regexp_extract_all(text, '{number_}\\s?°[CС]')) from documents
      union all select doc_id, 'thickness', unnest(regexp_extract_all(text, '{thick}', 1)) from documents
      union all select doc_id, 'density', unnest(regexp_extract_all(text, '{number_}\\s?кг/м³')) from documents)"""
    out["formula_operators"] = f"select doc_id, raw, regexp_matches(raw, '[=+\\-*/]') as has_operator from ({out['formula_mentions']})"
    out["memory_of_type"] = f"with {MEMORY} select pattern, success_count from mem where query_type = 'definition'"
    hit_tables = f"""{HITS}, top3 as (select query_id, rank, result_id as id, coalesce(doc_name, '') as doc_name, text from hits where rank <= 3), texts as (select id, text, doc_name as source from top3), {mined('texts')},
      ht as (select query_id, rank as hit, tabs.*, doc_name, row_number() over (partition by query_id, doc_name, left(raw_text, 200) order by rank, id, table_no) as n from top3 join tabs using (id)),
      hu as (select *, row_number() over (partition by query_id order by hit, id, table_no) as place from ht where n = 1)"""
    out["hit_table_records"] = f"with {hit_tables} select query_id, place, title, array_to_string(rows[1], '¦') as headers, (len(rows) - 1)::bigint as row_count, raw_text as content, doc_name from hu"
    out["full_reports"] = f"""with {hit_tables}, {best.removeprefix(f'with {HITS}, ')}, {answers}, body as (select query_id, 'answer' as section, (generate_subscripts(a, 1) - 1)::bigint as ord, unnest(a) as line from (select query_id, string_split(replace(answer, '*', ''), chr(10)) as a from ans)),
      tl as (select query_id, place, generate_subscripts(a, 1) as i, unnest(a) as line from (select query_id, place, list_concat([coalesce(title, 'Таблица')], string_split(raw_text, chr(10))) as a from hu where place <= 2)),
      fm as (select query_id, raw, row_number() over (partition by query_id order by raw) as k from ({out['hit_formulas']}))
      select * from body where {strip('line')} <> '' union all select query_id, 'source', ord, doc_name from o where ord <= 5 union all select query_id, 'table', row_number() over (partition by query_id order by place, i), line from tl
      union all select query_id, 'formula', k, concat_ws('; ', raw, array_to_string((list_sort(list_distinct(regexp_extract_all(raw, '{VARIABLE}'))))[1:5], ', ')) from fm where k <= 3"""
    split = r"string_split_regex(lower(query), '\s+и\s+|\s+vs\s+|\s+против\s+')"
    items = f"list_filter(list_transform({split}, lambda x: {strip('x')}), lambda x: length(x) > 2)"
    held = {"query": "query", "context": "context", "term": "term", "first": f"case when len({split}) > 1 then ({items})[1] end", "second": f"case when len({split}) > 1 then ({items})[2] end"}

    def prompt(kind: str) -> str:
        head, fields, steps = PROMPTS[kind]
        parts = [q(head), *(f"{q(title + ':')} || chr(10) || coalesce({held.get(name, 'null')}, '')" for title, name in fields), q("Инструкция:") + "".join(f" || chr(10) || {q(f'{i}. {x}')}" for i, x in enumerate(steps, 1)), q("Ответ:")]
        return " || chr(10) || chr(10) || ".join(parts)

    out["kind_prompts"] = f"""with {HITS}, c as (select query_id, string_agg('[' || rank || '] ' || coalesce(doc_name, '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by rank) as context from hits group by query_id), t as (select * from {asked_terms}),
      k as (select queries.query_id, query, {query_type('query')} as kind, context, term from queries left join c using (query_id) left join t using (query_id) where query is not null)
      select query_id, kind, case kind {' '.join(f"when {q(x)} then {prompt(x)}" for x in ('search', 'calculation', 'definition', 'comparison', 'regulatory'))} end as prompt from k"""
    full = CHUNKING.longest
    tail = f"(case when strpos(z, ' ') - 1 > 0 and strpos(z, ' ') - 1 < length(z) // 2 then {strip("substr(z, strpos(z, ' ') + 1)")} else z end)"
    out["chunk_documents"] = f"""with recursive pa as (select doc_id, generate_subscripts(p, 1) as para, unnest(p) as text from (select doc_id, list_filter(list_transform(string_split_regex({normalize('text')}, '\n{WS}*\n'), lambda x: {strip('x')}), lambda x: x <> '') as p from documents)),
      lo as (select doc_id, para, text, list_filter(list_transform({sentences('text')}, lambda x: {strip('x')}), lambda x: x <> '') as s from pa where length(text) > {full}),
      st as (select doc_id, para, s, 0::bigint as i, ''::varchar as held, null::varchar as piece, false as hard from lo where len(s) >= 2
        union all select doc_id, para, s, i + 1,
          case when length(cur) = 0 then s[i + 1] when length(cur) + 1 + length(s[i + 1]) <= {size} then cur || ' ' || s[i + 1] else {strip(f"{tail} || ' ' || s[i + 1]")} end,
          case when length(cur) > 0 and length(cur) + 1 + length(s[i + 1]) > {size} then {strip('cur')} end, false
          from (select *, case when length(held) > {size} and i > 0 and held = s[i] then '' else held end as cur, {strip(f"right(held, {overlap})")} as z from st) where i < len(s)),
      em as (select doc_id, para, i, piece, false as hard from st where piece is not null
        union all select doc_id, para, i, held, true from st where i > 0 and length(held) > {size} and held = s[i]
        union all select doc_id, para, i + 1, {strip('held')}, false from st where i = len(s) and not (length(held) > {size} and held = s[i]) and {strip('held')} <> ''
        union all select doc_id, para, 0, text, true from lo where len(s) < 2),
      hw as (select doc_id, para, i, piece as t, length(piece) as n, 0::bigint as a, 0::bigint as k from em where hard
        union all select doc_id, para, i, t, n, greatest(({cut}) - {overlap}, a + 1), k + 1 from hw where ({cut}) < n),
      al as (select doc_id, para, 0::bigint as i, 0::bigint as k, text from pa where length(text) <= {full} union all select doc_id, para, i, 0, piece from em where not hard
        union all select doc_id, para, i, k, {strip(f'substr(t, a + 1, ({cut}) - a)')} from hw)
      select doc_id, (row_number() over (partition by doc_id order by para, i, k) - 1)::int as chunk_id, text, len(list_filter(regexp_extract_all(text, '{FORMULA}'), lambda x: length({strip('x')}) >= 4)) > 0 as has_formula, {table_like('text')} as has_table_like_content from al where text <> ''"""
    qc = "qc as (select query_id, query, city from (select query_id, query, name as city, row_number() over (partition by query_id order by -length(name), name) as r from queries join cities on contains(lower(query), lower(name))) where r = 1)"
    out["table_plans"] = f"""with {qc} select * from (select query_id, city, case when {air} then case when {flow} is not null then 'ventilation' end when {wall} then case when {parameter('query', 'A')} is not null and {parameter('query', 'R')} is not null then 'heat_loss' end else 'gsop' end as plan from qc) where plan is not null"""
    hybrid = out["hybrid_search"]
    head = hybrid[: hybrid.rindex("select query_id, rank, parsed_id, chunk_id, score from (")].rstrip()
    out["qa_answers"] = f"""{head},
      hits as (select r.query_id, r.rank, r.rank as result_id, doc_name, text, score from ({ranked('h', 'score', 'parsed_id, chunk_id')}) r join chunks using (parsed_id, chunk_id)), {best.removeprefix(f'with {HITS}, ')}, {answers},
      so as (select query_id, string_agg(doc_name, '|' order by ord) as sources from o where ord <= 5 group by query_id)
      select q.query_id, case when so.query_id is null then {q(NOT_FOUND)} else coalesce(answer, '') end as answer, coalesce(sources, '') as sources, 'none' as provider, false as used_llm
        from (select query_id from queries where {_STEP}) q left join ans using (query_id) left join so using (query_id)"""
    return out
