"""SQL of the catalogue's queries for a second engine."""

from casewright.functions.exprs import MIME_TYPES
from casewright.operators.entities import HEBREW_STOPWORDS
from casewright.operators.persons import CONFIDENCE, NICKNAME, PART_OF_NAME

W = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"
COUNTS = 'select text entity, label "type", count(*) count from extractedentity {} group by all'
IN_CASE = "where evidence_id in (select id from evidence where case_id = 2)"
TOP = "select text, label, count(*) n from extractedentity where text is not null and label is not null group by all order by n desc, text, label limit 30"
STOP = "'" + "', '".join(HEBREW_STOPWORDS) + "'"
FAMILIES_OF = r"""
select @ID@, 'name' as label, unnest(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-zA-Z]{2,}'))) as text from @T@ where text is not null
union all select @ID@, 'name', unnest(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[А-ЯЁ][а-яё]{2,}'))) from @T@ where text is not null
union all select @ID@, 'phone', unnest(regexp_extract_all(text, '(?:^|[^0-9])((?:\+972|0)(?:[-\s]?[0-9]){8,10})\b', 1)) from @T@ where text is not null
union all select @ID@, 'israeli_id', unnest(regexp_extract_all(text, '\b[0-9]{9}\b')) from @T@ where text is not null
union all select @ID@, 'vehicle_plate', unnest(regexp_extract_all(text, '\b[0-9]{2,3}[-\s]?[0-9]{2,3}[-\s]?[0-9]{2,3}\b')) from @T@ where text is not null
union all select @ID@, 'hebrew_term', unnest(list_filter(regexp_extract_all(text, '[\x{0590}-\x{05FF}]{2,}'), lambda x: x not in (@STOP@))) from @T@ where text is not null
""".replace("@STOP@", STOP)
FAMILIES = FAMILIES_OF.replace("@ID@", "id").replace("@T@", "evidencechunk")
PHONE_RE = r"(?:^|[^0-9])((?:\+972|0)(?:[-\s]?[0-9]){8,10})\b"
DATE = r"\b([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})\b"
NORM = """case when regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then case when d like '0000%' then null else strftime(try_strptime(d, '%Y-%m-%d'), '%Y-%m-%d') end
when d like '%/0000' then null
when regexp_matches(d, '/[0-9]{4}$') then strftime(coalesce(try_strptime(d, '%d/%m/%Y'), try_strptime(d, '%m/%d/%Y')), '%Y-%m-%d')
when regexp_matches(d, '/[0-9]{2}$') then strftime(coalesce(try_strptime(d, '%d/%m/%y'), try_strptime(d, '%m/%d/%y')), '%Y-%m-%d') end"""
EVENTS = rf"""
with c as (select * from evidencechunk where text is not null @CASE@),
m as (select id, evidence_id, chunk_index, source_location, text, regexp_extract_all(text, '{DATE}') f, string_split_regex(text, '{DATE}') g from c),
e as (select *, unnest(range(1, len(f) + 1)) i from m where len(f) > 0),
x as (select *, f[i] d, cast(list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(f[1:i-1], lambda s: length(s))), 0) as bigint) p from e)
select id chunk_id, evidence_id, chunk_index, source_location, p "position", d "date", {NORM} normalized_date,
 case when p > 150 then '...' else '' end || substr(text, greatest(p - 150, 0) + 1, least(p + length(d) + 150, length(text)) - greatest(p - 150, 0)) || case when p + length(d) + 150 < length(text) then '...' else '' end as text from x
"""
CASE_CHUNKS = "and evidence_id in (select id from evidence where case_id = 2)"
TOK = "regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+')"
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: cast(z[1] as double) * cast(z[2] as double)))"
PAIRS = f"""
with f as (select * from embeddings {{}} order by vec_id limit 500),
s as (select a.vec_id a, b.vec_id b, {DOT.format("a.embedding", "b.embedding")} s from f a join f b on a.vec_id < b.vec_id and a.label <> b.label)
select a, b, round(s, 4) similarity, 'unverified' verdict from s where s >= {{}} order by s desc, a, b limit 8
"""
SEMANTIC = f"""
select vec_id, label, round({DOT.format("embedding", "(select embedding from embeddings where vec_id = 0)")}, 6) score from embeddings {{}} qualify score > 0 order by score desc, vec_id limit 10
""".replace("qualify score > 0", "")
AUDIT = "(select distinct on (id) *, cast(json_extract_string(details_json, '$.case_id') as bigint) case_id from auditevent {})"
ISO = "replace(strftime({}, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '')"
PAYLOAD = "concat(event_type, '|', coalesce(cast(evidence_id as varchar), 'None'), '|', " + ISO.format("created_at") + ", '|', details_json)"
VERIFY = f"""
with e as (select distinct on (id) *, cast(json_extract_string(details_json, '$.case_id') as bigint) case_id from {{}}),
h as (select *, coalesce(event_hash, '') <> '' hashed, coalesce(lag(event_hash) over (partition by case_id, coalesce(event_hash, '') <> '' order by id), '') b from e),
k as (select *, hashed and (coalesce(prev_hash, '') <> b or sha256(coalesce(prev_hash, '') || '|' || {PAYLOAD}) <> event_hash) broken from h),
f as (select *, min(id) filter (broken) over (partition by case_id) stop from k)
select case_id, stop is null ok, stop broken_at_id, count(*) filter (hashed and (stop is null or id < stop)) checked, count(*) filter (not hashed and (stop is null or id < stop)) legacy_unhashed from f group by case_id, stop
"""
ANSWERS = "(values ('A [_1] b [1, 2]'), ('[7] none'), ('only [1][2]'), ('CONTRADICTION | both'), ('  consistent  '), ('_theשלום [__2] x'), ('[1,9, 3,4 , 5] end [12]'), ('contradiction: a | b | c' || chr(10) || 'more'), ('[3]'), ('12 [1] .'), ('Consistent' || chr(10) || 'CONTRADICTION | x'), ('')) t(raw)"
OTHER = "('gif','docx','xlsx','pptx','eml','msg')"
IMG = "('png','jpg','jpeg','tif','tiff','bmp','webp')"
MED = "('mp3','wav','m4a','ogg','flac','mp4','mkv','avi','mov','webm')"
EXT = r"lower(regexp_extract(filename, '\.([^./]+)$', 1))"
LEGAL = f"({EXT} in {OTHER} or {EXT} in {IMG} or {EXT} in {MED} or {EXT} in ('txt','pdf'))"
BLANK = r"coalesce(length(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), 0) = 0"
STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
TEXT_VECTORS = rf"""
t as (select id, unnest(string_split_regex({STRIP.format("lower(text)")}, '[\s\p{{Z}}]+')) w from evidencechunk where text is not null @CASE@),
n as (select id, cast(('0x' || substr(sha256(w), 1, 2)) as int) % 384 b, count(*) n from t where w <> '' group by all),
q as (select cast(('0x' || substr(sha256(w), 1, 2)) as int) % 384 b, count(*) m from (select unnest(string_split('@QUERY@', ' ')) w) group by all),
s as (select id, round(sum(n * coalesce(m, 0)) / (sqrt(sum(n * n)) * (select sqrt(sum(m * m)) from q)), 6) score from n left join q using (b) group by id),
r as (select id, score, row_number() over (order by score desc, id) "rank" from s where score > 0 order by score desc, id limit @LIMIT@),
hits as (select r.id, c.evidence_id, (select min(filename) from evidence v where v.id = c.evidence_id) filename, c.chunk_index, c.source_location, r.score, c.text, r."rank" from r join evidencechunk c on c.id = r.id)
"""
def text_hits(query, limit, case=""):
    return "with " + TEXT_VECTORS.replace("@QUERY@", query).replace("@LIMIT@", str(limit)).replace("@CASE@", case)


QUESTION = "where was the van seen before midnight"
ANSWER = """
select case when count(*) = 0 then 'none' else 'citations_only' end "mode",
 case when count(*) = 0 then 'No relevant evidence was found.' else @STRIP@ end answer from hits
""".replace("@STRIP@", STRIP.format("'Relevant evidence was found. Review the cited chunks below.' || chr(10) || chr(10) || string_agg('[' || \"rank\" || '] ' || coalesce(filename, 'None') || ' (Evidence ID: ' || evidence_id || ', Chunk: ' || chunk_index || ', Location: ' || coalesce(source_location, 'None') || ')' || chr(10) || coalesce(text, '') || chr(10), chr(10) order by \"rank\")"))
ASKED = "(select embedding from evidencechunk where embedding_model = 'text-enc-s' and len(embedding) = 64 order by id limit 1)"
MODEL = "(coalesce(embedding_model, '') = '' or embedding_model = 'text-enc-s')"


def vector_hits(case=""):
    return f"""with s as (select id, round({DOT.format("embedding", ASKED)}, 6) score from evidencechunk where {MODEL} and len(embedding) = 64 {case}),
        r as (select id, score, row_number() over (order by score desc, id) "rank" from s where score > 0 order by score desc, id limit 20)
        select r.id, c.evidence_id, (select min(filename) from evidence v where v.id = c.evidence_id) filename, c.chunk_index, c.source_location, r.score, c.text, r."rank" from r join evidencechunk c on c.id = r.id"""


def text_pairs(first, case, threshold):
    return f"""with c as (select * from (select * from evidencechunk order by id {first}) where {MODEL} and len(embedding) > 0 {case}),
        p as (select a.id a, b.id b, a.evidence_id evidence_a, b.evidence_id evidence_b, substr(coalesce(a.text, ''), 1, 300) text_a, substr(coalesce(b.text, ''), 1, 300) text_b, {DOT.format("a.embedding", "b.embedding")} s
              from c a join c b on a.id < b.id and a.evidence_id <> b.evidence_id and len(a.embedding) = len(b.embedding)),
        t as (select * from p where s >= {threshold} order by s desc, a, b limit 20)
        select 'unverified' verdict, round(s, 4) similarity, '' explanation, (select min(filename) from evidence v where v.id = evidence_a) filename_a, (select min(filename) from evidence v where v.id = evidence_b) filename_b,
         evidence_a, evidence_b, text_a, text_b, evidence_a evidence_id, text_a as text from t"""


def phrase(words, limit, case=""):
    at = " and ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(words.split()))
    return f"""with p as (select id, evidence_id, {TOK} t from evidencechunk where text is not null),
        h as (select id, evidence_id, len(t) n, len(list_filter(range(1, len(t) + 1), lambda i: {at})) tf from p),
        k as (select count(*) docs, avg(len(t)) mean from p), g as (select count(*) df from h where tf > 0),
        s as (select id, evidence_id, case when ln((docs - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((docs - df + 0.5) / (df + 0.5)) end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) b from h, k, g where tf > 0),
        r as (select id, round(b, 6) bm25 from s {case} order by bm25 desc, id limit {limit})
        select r.id, c.evidence_id, (select min(filename) from evidence v where v.id = c.evidence_id) filename, c.chunk_index, c.source_location, cast(1.0 as double) score, c.text, r.bm25 from r join evidencechunk c on c.id = r.id"""


def like(pattern, case=""):
    return f"""select c.id, c.evidence_id, v.filename, c.chunk_index, c.source_location, cast(1.0 as double) score, c.text from evidencechunk c join evidence v on v.id = c.evidence_id
        where translate(c.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '{pattern}' {case} order by c.id limit 100"""


PHONES = rf"""
with m as (select c.id, c.evidence_id, v.case_id, v.filename, c.source_location, c.text, regexp_extract_all(text, '{PHONE_RE}', 0) f, regexp_extract_all(text, '{PHONE_RE}', 1) m, string_split_regex(text, '{PHONE_RE}') g
   from evidencechunk c join evidence v on v.id = c.evidence_id where text is not null and v.case_id is not null),
e as (select *, unnest(range(1, len(f) + 1)) i from m where len(f) > 0),
x as (select *, m[i] phone, cast(list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(f[1:i-1], lambda s: length(s))), 0) + length(f[i]) - length(m[i]) as bigint) p from e),
n as (select distinct person_id, name, case_id, person_name from (select id person_id, name, case_id, name person_name from person union all
   select l.person_id, l.value, p.case_id, p.name from personlink l join person p on p.id = l.person_id where l.kind = 'alias') where length(name) >= 2),
h as (select x.*, n.person_id, n.name, n.person_name, list_min(list_transform(list_filter(range(0, length(text) - length(name) + 1), lambda j: substr(text, j + 1, length(name)) = name), lambda j: least(abs(j - (p + length(phone))), abs(p - (j + length(name)))))) d
   from x join n on n.case_id = x.case_id and contains(text, name)),
k as (select *, [{", ".join(map(str, CONFIDENCE))}][d + 1] confidence, regexp_replace(phone, '[^0-9]', '', 'g') norm from h where d <= 120),
o as (select * from k where not exists (select 1 from personlink l where l.kind = 'phone' and l.person_id = k.person_id and regexp_replace(l.value, '[^\p{{Nd}}]', '', 'g') = k.norm)),
b as (select *, row_number() over (partition by person_id, norm order by confidence desc, id, p, length(name) desc, name) r from o)
select person_id, person_name, name matched_name, phone, d distance, confidence, evidence_id, filename, source_location,
 substr(text, greatest(least(p, instr(text, name) - 1) - 20, 0) + 1, least(length(text), greatest(p + length(phone), instr(text, name) - 1 + length(name)) + 20) - greatest(least(p, instr(text, name) - 1) - 20, 0)) snippet from b where r = 1
"""
SUFFIX = "case when doc_id % 7 = 0 and doc_id % 5 <> 0 then 'docx' else 'txt' end"
FILES = f"""
f as (select doc_id, coalesce(text, '') text, 'doc_' || doc_id || case when doc_id % 5 = 0 then '.TXT' when doc_id % 7 = 0 then '.docx' else '.txt' end filename, {SUFFIX} suffix, strlen(coalesce(text, '')) size_bytes, sha256(coalesce(text, '')) sha256 from documents),
p as (select *, '/intake/' || filename original_path from f),
w as (select *, row_number() over (partition by sha256 order by original_path) r, (select min(id) from evidence v where v.sha256 = p.sha256) known from p),
n as (select *, (select max(id) from evidence) + row_number() over (order by original_path) id from w where r = 1 and known is null)
"""
IMPORTED = f"""
{FILES}, b as (select id, suffix, {STRIP.format("text")} t from n),
c as (select id evidence_id, t, length(t) n, unnest(range(cast(greatest(ceil((length(t) - 1200) / 1050.0), 0) as int) + 1)) * 1050 s from b where suffix = 'txt' and t <> ''),
q as (select evidence_id, s, least(s + 1200, n) e, substr(t, s + 1, 1200) as text from c), z as (select * from q where not ({BLANK})),
chunks as (select evidence_id, cast(row_number() over (partition by evidence_id order by s) - 1 as int) chunk_index, text, 'chars:' || s || '-' || e source_location from z)
"""


def esc(c):
    return f"""replace(replace(replace(replace(replace(coalesce(cast({c} as varchar), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


def cells(*columns):
    return "'<tr>' || " + " || ".join(f"'<td>' || {esc(c)} || '</td>'" for c in columns) + " || '</tr>'"


GROUPS = r"\[\d+(?:\s*,\s*\d+)*\]"
GLUED = r"regexp_replace(regexp_replace(raw, '\[_+(\d+)\]', '[\1]', 'g'), '^[_a-zA-Z]{1,8}([\x{0590}-\x{05FF}])', '\1')"
CLEAN = rf"""
with a as (select raw, {GLUED} s from {ANSWERS}),
b as (select raw, regexp_extract_all(s, '{GROUPS}') f, string_split_regex(s, '{GROUPS}') g from a)
select raw, trim(array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || case when i > len(f) then '' else
 array_to_string(list_transform(list_filter(string_split(regexp_replace(f[i], '[\[\]\s]', '', 'g'), ','), lambda n: cast(n as bigint) between 1 and 5), lambda n: '[' || n || ']'), '') end), '')) clean from b
"""
LINE = "trim(regexp_extract(trim(raw), '^[^\\n\\r]*'))"
REMAIN = """
select 'evidence' tbl, count(*) remaining from evidence where case_id is distinct from 2
union all select 'evidencechunk', count(*) from evidencechunk where evidence_id is null or evidence_id not in (select id from evidence where case_id = 2)
union all select 'extractedentity', count(*) from extractedentity where evidence_id is null or evidence_id not in (select id from evidence where case_id = 2)
union all select 'person', count(*) from person where case_id is distinct from 2
union all select 'personlink', count(*) from personlink where person_id is null or person_id not in (select id from person where case_id = 2)
"""
NAME = r"regexp_replace(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'), '^ +| +$', '', 'g')"
ALIASES = f"""
with p as (select id person_id, case_id, {NAME.format("name")} name from person),
c as (select case_id, name from p union select p.case_id, {NAME.format("l.value")} from personlink l join p using (person_id) where l.kind = 'alias'),
k as (select distinct v.case_id, {NAME.format("e.text")} name from extractedentity e join evidence v on v.id = e.evidence_id where v.case_id is not null and e.label in ('person', 'name', 'hebrew_term')),
o as (select k.case_id, k.name from k where length(k.name) >= 2 and not exists (select 1 from c where c.case_id = k.case_id and c.name = k.name)),
t as (select distinct person_id, case_id, unnest(string_split(name, ' ')) tok from p)
select person_id, (select name from person where id = person_id) person_name, o.name alias, max(case when o.name = tok then 0.9 else 0.6 end) confidence, case when max(case when o.name = tok then 0.9 else 0.6 end) > 0.8 then '@A@' else '@B@' end reason from o join t on o.case_id = t.case_id and tok <> ''
 and (o.name = tok or (length(tok) >= 3 and starts_with(o.name, tok) and length(o.name) - length(tok) between 1 and 2)) group by person_id, o.name
""".replace("@A@", PART_OF_NAME).replace("@B@", NICKNAME)

SQL = {
    "entity_counts": COUNTS.format(""),
    "entity_counts_by_case": COUNTS.format(IN_CASE),
    "entity_graph_nodes": f'select text entity, label "type", n count from ({TOP})',
    "entity_graph_edges": f"""with t as ({TOP}), h as (select distinct evidence_id, text, label from extractedentity join t using (text, label))
        select x.text a, x.label a_label, y.text b, y.label b_label, count(*) weight from h x join h y on x.evidence_id = y.evidence_id and (x.text, x.label) < (y.text, y.label)
        group by all order by weight desc, 1, 2, 3, 4 limit 200""",
    "graph_layout": f"""with t as (select *, row_number() over (order by n desc, text, label) r, count(*) over () k from ({TOP}))
        select text entity, label "type", cast(14 + least(floor(ln(n + 1.0) * 10), 30) as bigint) size, round(cos((r - 1) * (2 * 3.141592653589793) / k) * 300, 4) x, round(sin((r - 1) * (2 * 3.141592653589793) / k) * 300, 4) y from t""",
    "extract_entities": FAMILIES,
    "regex_entity_scan": f"select label, text, count(*) count from ({FAMILIES}) group by all",
    "evidence_dedupe": "select id, sha256, f first_id, id > f duplicate from evidence join (select sha256, min(id) f from evidence group by 1) using (sha256)",
    "folder_import_summary": f"""with d as (select {LEGAL} ok, id > min(id) over (partition by sha256) dup from evidence)
        select count(*) scanned, count(*) filter (ok) accepted, count(*) filter (ok and not dup) registered, count(*) filter (ok and dup) duplicates from d""",
    "evidence_by_id": "select id, case_id, filename, sha256, status from evidence where id = 7",
    "evidence_page": "select id, filename, status from evidence order by id limit 100 offset 50",
    "index_status": f"""with k as (select evidence_id, count(*) n from evidencechunk where not ({BLANK}) group by 1)
        select id, coalesce(n, 0) chunks, case when {EXT} in {OTHER} or not {LEGAL} then 'extraction_not_supported' when coalesce(n, 0) = 0 then 'no_text_found'
        when {EXT} in {MED} then 'transcribed' when {EXT} in {IMG} then 'ocr_indexed' else 'indexed' end new_status from evidence left join k on k.evidence_id = id""",
    "chunk_documents": f"""with b as (select doc_id, text, length(text) n, cast(greatest(ceil((length(text) - 1200) / 1050.0), 0) as int) + 1 k from documents where text is not null and not ({BLANK})),
        p as (select doc_id, n, unnest(range(k)) * 1050 s, text t from b), q as (select doc_id, s, least(s + 1200, n) e, substr(t, s + 1, 1200) as text from p), z as (select * from q where not ({BLANK}))
        select doc_id, row_number() over (partition by doc_id order by s) - 1 chunk_index, s start_char, e end_char, 'chars:' || s || '-' || e source_location, text from z""",
    "segment_packing": rf"""with recursive s as (select evidence_id, row_number() over (partition by evidence_id order by chunk_index, c.id) r, length(regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) n
          from evidencechunk c where not ({BLANK}) and evidence_id in (select id from evidence where status = 'transcribed')),
        w as (select evidence_id, r, 0 pack, 1 k, n c from s where r = 1 union all
          select s.evidence_id, s.r, case when w.c >= 1000 then w.pack + 1 else w.pack end, case when w.c >= 1000 then 1 else w.k + 1 end, case when w.c >= 1000 then s.n else w.c + s.n end from w join s on s.evidence_id = w.evidence_id and s.r = w.r + 1)
        select evidence_id, pack, max(k) segments, max(c) chars from w group by all""",
    "integrity_check": """with x as (select id, filename, sha256, nullif(regexp_extract(stored_path, '([0-9a-f]{64})', 1), '') a from evidence)
        select id, filename, sha256 expected, a actual, case when a is null then 'missing' when a <> sha256 then 'tampered' else 'verified' end state from x""",
    "status_counts": "select count(*) evidence_total, count(*) filter (status = 'processing') processing, count(*) filter (status = 'processing') > 0 busy from evidence",
    "case_delete_cascade": REMAIN,
    "person_delete_cascade": "select id, person_id, kind from personlink where person_id <> 5 and related_person_id is distinct from 5",
    "timeline": EVENTS.replace("@CASE@", ""),
    "timeline_by_case": EVENTS.replace("@CASE@", CASE_CHUNKS),
    "timeline_page": f"select * from ({EVENTS.replace('@CASE@', '')}) order by normalized_date is null, coalesce(normalized_date, \"date\"), evidence_id, chunk_index, chunk_id, \"position\" limit 100 offset 20",
    "date_normalization": f"select d raw, {NORM} normalized from (values ('05/03/99'), ('05/03/68'), ('1/2/202'), ('31/02/2024'), ('13/02/99'), ('12/25/2024'), ('0000-01-01'), ('2024-02-30'), ('2024-02-29'), ('7/8/2021'), ('25/12/20')) t(d)",
    "keyword_search_bm25": f"""with p as (select id, {TOK} t from evidencechunk where text is not null),
        h as (select id, len(t) n, len(list_filter(range(1, len(t) - 1), lambda i: t[i] = 'before' and t[i+1] = 'the' and t[i+2] = 'warehouse')) tf from p),
        k as (select count(*) docs, avg(len(t)) mean from p), g as (select count(*) df from h where tf > 0),
        s as (select id, case when ln((docs - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((docs - df + 0.5) / (df + 0.5)) end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) b from h, k, g where tf > 0)
        select id, cast(1.0 as double) score, round(b, 6) bm25 from s order by bm25 desc, id limit 50""",
    "keyword_search_like": "select c.id, c.evidence_id, v.filename, c.chunk_index, cast(1.0 as double) score from evidencechunk c join evidence v on v.id = c.evidence_id where contains(lower(c.text), 'motorcycle')",
    "semantic_search": f"select * from ({SEMANTIC.format('').split(' order by')[0]}) where score > 0 order by score desc, vec_id limit 10",
    "semantic_search_by_case": f"select * from ({SEMANTIC.format('where label = 3').split(' order by')[0]}) where score > 0 order by score desc, vec_id limit 10",
    "contradiction_pairs": PAIRS.format("", 0.3),
    "hash_embedding": r"""with t as (select id, unnest(string_split_regex(regexp_replace(lower(text), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '\s+')) t from evidencechunk where text is not null),
        n as (select id, cast(('0x' || substr(sha256(t), 1, 2)) as int) % 384 bucket, count(*) n from t where t <> '' group by all)
        select id, bucket, round(n / sqrt(sum(n * n) over (partition by id)), 6) weight from n""",
    "clean_answer": r"""select raw, trim(regexp_replace(regexp_replace(regexp_replace(raw, '\[_(\d+)\]', '[\1]', 'g'), '\[(\d+)\s*,\s*(\d+)\]', '[\1][\2]', 'g'), '\[(?:[06-9]|\d\d+)\]', '', 'g')) clean from """ + ANSWERS,
    "has_prose": r"select raw, regexp_matches(regexp_replace(raw, '\[\d+\]', '', 'g'), '\p{L}') prose from " + ANSWERS,
    "verdict_parse": "select raw, case when starts_with(upper(trim(raw)), 'CONTRADICTION') then 'contradiction' when starts_with(upper(trim(raw)), 'CONSISTENT') then 'consistent' end verdict from " + ANSWERS,
    "person_list": "select p.id, p.case_id, p.name, count(l.id) links, count(*) filter (l.kind = 'alias') aliases, min(l.id) first_link from person p left join personlink l on l.person_id = p.id group by all",
    "person_graph_nodes": "select id, name, in_evidence from person where case_id = 2",
    "person_graph_edges": "select a.case_id, l.person_id a, l.related_person_id b, l.value label from personlink l join person a on a.id = l.person_id join person b on b.id = l.related_person_id where l.kind = 'relation' and a.case_id = b.case_id",
    "alias_suggestions": ALIASES,
    "link_validation": """select l.id, case when kind = 'photo' then l.evidence_id in (select id from evidence) and l.evidence_id is not null when kind = 'relation' then related_person_id is not null and related_person_id in (select id from person)
        else coalesce(kind in ('alias', 'phone'), false) end valid from personlink l""",
    "audit_chain_verify": VERIFY.format(""),
    "audit_chain_tampered": VERIFY.format("where id % 97 <> 0"),
    "audit_page": "select distinct id, event_type, evidence_id from auditevent order by id desc limit 100 offset 10",
    "report_evidence": "select id, filename, sha256, status from evidence where case_id = 2",
    "report_timeline": f"select normalized_date, count(*) events from ({EVENTS.replace("@CASE@", CASE_CHUNKS)}) group by 1",
    "report_entities": 'select text entity, label "type", count(*) count from extractedentity where text is not null and label is not null and evidence_id in (select id from evidence where case_id = 2) group by all order by count desc, 1, 2 limit 50',
    "report_audit": "select distinct id, event_type, evidence_id from auditevent where evidence_id in (select id from evidence where case_id = 2)",
    "html_escape": """select id, coalesce(replace(replace(replace(replace(replace('<b>''' || value || ''' & "</b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '') html from personlink""",
    "human_size": "select id, case when size_bytes < 1024 then size_bytes || ' B' when size_bytes < 1048576 then cast(floor(size_bytes / 1024 + 0.5) as bigint) || ' KB' else printf('%.1f MB', size_bytes / 1048576) end size from evidence",
    "rtl_detection": f"select id, len(list_filter({W}, lambda w: regexp_full_match(w, '[םןףץך][א-ת]+'))) starts, len(list_filter({W}, lambda w: regexp_full_match(w, '[א-ת]+[םןףץך]'))) ends from evidencechunk where text is not null",
    "stream_index": f"select label, count(*) n from ({FAMILIES}) group by 1",
}

SQL["audit_chain_build"] = r"""
with recursive e as (select distinct on (id) *, cast(json_extract_string(details_json, '$.case_id') as bigint) case_id from auditevent),
p as (select case_id, id, row_number() over (partition by case_id order by id) r, concat(event_type, '|', coalesce(cast(evidence_id as varchar), 'None'), '|',
  replace(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', ''), '|', details_json) payload from e),
h as (select case_id, id, r, sha256('|' || payload) event_hash from p where r = 1
  union all select p.case_id, p.id, p.r, sha256(h.event_hash || '|' || p.payload) from h join p on p.case_id = h.case_id and p.r = h.r + 1)
select case_id, id, event_hash from h
"""

EDGES = SQL["entity_graph_edges"]
SQL |= {
    "entity_graph_edges_by_case": "with extractedentity as (select * from main.extractedentity where evidence_id in (select id from evidence where case_id = 2)) select *, least(weight + 1, 6) width from (" + EDGES + ")",
    "entity_list": COUNTS.format("") + " order by 3 desc, 1, 2",
    "entity_list_without_entities": f"select text entity, label \"type\", count(*) count from ({FAMILIES}) group by all",
    "evidence_dedupe": "select id, sha256, coalesce(f, id) first_id, id > coalesce(f, id) duplicate from evidence left join (select sha256, min(id) f from evidence where sha256 is not null group by 1) using (sha256)",
    "keyword_index": f"select token, count(distinct id) df, count(*) occurrences from (select id, unnest({TOK}) token from evidencechunk where text is not null) group by 1",
    "keyword_search_bm25": phrase("before the warehouse", 50),
    "keyword_search_by_case": phrase("the witness", 20, "where evidence_id in (select id from evidence where case_id = 2)"),
    "keyword_search_like": like("%motor_ycle%"),
    "keyword_search_like_by_case": like("%the%gate%", "and v.case_id = 2"),
    "stream_keywords": f"select id, bm25 from ({phrase('before the warehouse', 50)})",
    "semantic_search_chunks": vector_hits(),
    "semantic_search_by_case": vector_hits("and evidence_id in (select id from evidence where case_id = 2)"),
    "semantic_search_text": text_hits("the witness saw a white van near the warehouse", 20) + "select * from hits",
    "contradiction_pairs_all": PAIRS.replace("limit 500", "").replace("limit 8", "limit 50").format("", 0.3),
    "contradiction_texts": text_pairs("limit 500", "", 0.5),
    "contradiction_texts_by_case": text_pairs("", "and evidence_id in (select id from evidence where case_id = 2)", 0.3),
    "ask_citations_only": text_hits(QUESTION, 5) + ANSWER,
    "ask_by_case": text_hits(QUESTION, 5, CASE_CHUNKS) + ANSWER,
    "ask_without_question": "select 'none' \"mode\", 'No question provided.' answer",
    "answer_excerpts": text_hits(QUESTION, 5) + "select \"rank\", '[' || \"rank\" || '] (file: ' || coalesce(filename, 'None') || ', location: ' || coalesce(source_location, 'None') || ')' || chr(10) || coalesce(text, '') excerpt from hits",
    "answer_language": r"select raw, regexp_matches(raw, '[\x{0590}-\x{05FF}]') hebrew from " + ANSWERS,
    "clean_answer": CLEAN,
    "verdict_parse": f"""select raw, case when starts_with(upper({LINE}), 'CONTRADICTION') then 'contradiction' when starts_with(upper({LINE}), 'CONSISTENT') then 'consistent' end verdict,
        case when starts_with(upper({LINE}), 'CONTRADICTION') and contains({LINE}, '|') then trim(regexp_replace({LINE}, '^[^|]*\\|', '')) else '' end explanation from {ANSWERS}""",
    "import_register": f"""with {FILES} select id, cast(2 as bigint) case_id, original_path, sha256 || '.' || suffix stored_path, filename, sha256, size_bytes,
        case suffix when 'txt' then 'text/plain' else 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' end mime_type, 'processing' status from n""",
    "import_duplicates": f"with {FILES} select w.original_path, w.sha256, coalesce(w.known, n.id) existing_id from w left join n on n.sha256 = w.sha256 where w.r > 1 or w.known is not null",
    "import_summary": f"with {FILES} select (select count(*) from w) scanned, (select count(*) from n) registered, (select count(*) from w where r > 1 or known is not null) duplicates",
    "import_status": f"""with {IMPORTED} select b.id, count(chunks.text) chunks, case when count(chunks.text) > 0 then 'indexed' when any_value(b.suffix) = 'docx' then 'extraction_not_supported' else 'no_text_found' end status
        from b left join chunks on chunks.evidence_id = b.id group by b.id""",
    "import_chunks": f"with {IMPORTED} select evidence_id, chunk_index, text, source_location, 'fallback-hash-384d' embedding_model, 384 embedding_dimension, cast(1.0 as double) norm from chunks",
    "import_entities": f"with {IMPORTED} " + FAMILIES_OF.replace("@ID@", "evidence_id, chunk_index").replace("@T@", "chunks"),
    "import_roots": "select id, starts_with(original_path, '/intake/box3/') or starts_with(original_path, '/intake/box12/') allowed from evidence",
    "resume_pending": f"""with t as (select evidence_id, string_agg(text, ' ' order by chunk_index, id) as text from evidencechunk where text is not null group by 1)
        select id, case when status <> 'processing' then status when text is null or ({BLANK}) then 'no_text_found' else 'indexed' end status from evidence left join t on evidence_id = id""",
    "reindex_reset": "select id, case when id = 7 then 'processing' else status end status from evidence",
    "evidence_delete": """with g as (select id from evidence where status = 'text_extraction_failed' or id = 7)
        select 'evidence' tbl, count(*) remaining from evidence where id not in (select id from g) union all select 'evidencechunk', count(*) from evidencechunk where evidence_id is null or evidence_id not in (select id from g)
        union all select 'extractedentity', count(*) from extractedentity where evidence_id is null or evidence_id not in (select id from g)""",
    "column_migration": "select id, '' embedding_model, 0 embedding_dimension, '1' embedding_version from evidencechunk",
    "case_create": "select id, name from casefile union all select max(id) + 1, 'New case' from casefile",
    "case_page": "select id, name from casefile order by id limit 10 offset 2",
    "evidence_listed": f"select id, case_id, original_path, stored_path, filename, sha256, size_bytes, mime_type, {ISO.format('imported_at')} imported_at, status from evidence",
    "evidence_photos": "select id, filename, mime_type from evidence where starts_with(mime_type, 'image/')",
    "integrity_summary": f"""select count(*) filter (state = 'verified') verified, count(*) filter (state = 'missing') missing, count(*) filter (state = 'tampered') tampered, count(*) filter (state <> 'verified') = 0 ok from ({SQL["integrity_check"]})""",
    "person_nested": """select p.id, p.case_id, p.name, p.description, p.in_evidence, coalesce((select to_json(list({'id': l.id, 'kind': l.kind, 'value': l.value, 'evidence_id': l.evidence_id, 'related_person_id': l.related_person_id, 'confidence': l.confidence} order by l.id))
        from personlink l where l.person_id = p.id), '[]') links from person p where p.case_id = 2""",
    "person_changes": """select id, case_id, case when id = 5 then 'Renamed' else name end "name", description, in_evidence from person where id <> 9
        union all select max(id) + 1, 2, 'New Person', 'added', true from person""",
    "link_changes": """with l as (select id, person_id, kind, value, confidence from personlink union all select max(id) + 1, 6, 'alias', 'Shorty', 1.0 from personlink)
        select * from l where not (person_id = 5 and id in (3, 4))""",
    "phone_suggestions": PHONES,
    "audit_chain_verify": VERIFY.format("auditevent"),
    "audit_chain_tampered": VERIFY.format("(select * from auditevent where id % 97 <> 0)"),
    "audit_chain_edited": VERIFY.format("(select * replace (case when id % 100 = 50 then details_json || ' ' else details_json end as details_json) from auditevent)"),
    "report_evidence": f"select id, filename, sha256, size_bytes, status, {ISO.format('imported_at')} imported_at from evidence where case_id = 2",
    "report_timeline": f"select coalesce(normalized_date, \"date\") \"date\", evidence_id, source_location, text from ({EVENTS.replace('@CASE@', CASE_CHUNKS)})",
    "report_audit": f"select {ISO.format('created_at')} created_at, event_type, evidence_id from (select distinct on (id) * from auditevent) where evidence_id in (select id from evidence where case_id = 2)",
    "rtl_detection": r"""with w as (select id, regexp_extract_all(text, '[\x{0590}-\x{05FF}]{2,}') w from evidencechunk where text is not null),
        n as (select id, len(list_filter(w, lambda x: regexp_matches(x, '^[םןףץך]'))) starts, len(list_filter(w, lambda x: regexp_matches(x, '[םןףץך]$'))) ends from w) select *, starts > ends reversed from n""",
    "vector_csv": "select id, coalesce(array_to_string(list_transform(embedding, lambda x: printf('%.6f', cast(x as double))), ','), '') csv, coalesce(len(embedding), 0) dimension from evidencechunk",
    "vector_round_trip": "select id, coalesce(round(list_sum(list_transform(embedding, lambda x: round(cast(x as double), 6))), 3), 0) \"sum\", coalesce(len(embedding), 0) n from evidencechunk",
    "time_format": "select id, printf('%02d:%02d', cast(floor(floor(size_bytes / 7) / 60) as bigint), cast(floor(size_bytes / 7) as bigint) % 60) mmss from evidence",
    "role_text": "select id, 'query: ' || name query, 'passage: ' || name passage, name raw from person",
    "table_display": f"select id, regexp_extract(coalesce(mime_type, ''), '[^/]*$') \"type\", replace(substr({ISO.format('imported_at')}, 1, 16), 'T', ' ') shown from evidence",
    "preview_needle": f"select chunk_id, \"position\", substr({STRIP.format(chr(39).join(['regexp_replace(text, ', '^[.]+|[.]+$', ', ', '', ', ', 'g', ')']))}, 1, 60) needle from ({EVENTS.replace('@CASE@', CASE_CHUNKS)})",
    "json_rows": "select id, to_json({'text': text, 'label': label}) json from extractedentity",
}
SQL["mime_guess"] = "select id, coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in MIME_TYPES.items()) + "}[" + EXT + "], 'application/octet-stream') mime from evidence"
SQL["report_page"] = f"""
select 0 section, {cells('id', 'filename', 'sha256', 'size_bytes', 'status', 'imported_at')} "row" from ({SQL['report_evidence']})
union all select 1, {cells('"date"', 'evidence_id', 'source_location', 'text')} from ({SQL['report_timeline']})
union all select 2, {cells('entity', '"type"', '"count"')} from ({SQL['report_entities']})
union all select 3, {cells('created_at', 'event_type', 'evidence_id')} from ({SQL['report_audit']})
"""
SQL["segment_packing"] = rf"""with recursive s as (select evidence_id, row_number() over (partition by evidence_id order by chunk_index, c.id) r, regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') t, regexp_extract(source_location, '^time:([0-9]+:[0-9]+)-([0-9]+:[0-9]+)$', 1) a, regexp_extract(source_location, '^time:([0-9]+:[0-9]+)-([0-9]+:[0-9]+)$', 2) z
  from evidencechunk c where not ({BLANK}) and evidence_id in (select id from evidence where status = 'transcribed')),
w as (select evidence_id, r, 0 pack, 1 k, length(t) c, t, a, z from s where r = 1 union all
  select s.evidence_id, s.r, case when w.c >= 1000 then w.pack + 1 else w.pack end, case when w.c >= 1000 then 1 else w.k + 1 end, case when w.c >= 1000 then length(s.t) else w.c + length(s.t) end,
   case when w.c >= 1000 then s.t else w.t || ' ' || s.t end, case when w.c >= 1000 then s.a else w.a end, s.z from w join s on s.evidence_id = w.evidence_id and s.r = w.r + 1)
select evidence_id, pack, max(k) segments, max(c) chars, arg_max(t, k) as text, 'time:' || arg_max(a, k) || '-' || arg_max(z, k) source_location from w group by evidence_id, pack"""
