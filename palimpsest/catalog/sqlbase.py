"""Oracle SQL fragments: the adapters of ``plans.adapters`` stated for DuckDB, and shared text steps."""

MSG = """messages AS (
  SELECT conv_id*1000+turn+1 AS id, lpad(CAST(conv_id AS VARCHAR),26,'0') AS session_id,
         make_timestamp(1704067200000000 + conv_id*3600000000 + (turn*(turn+1)//2)*60000000) AS ts,
         role, text AS content, (role='assistant' AND turn%4=3) AS is_summary
  FROM conversations)"""

NODES = """nodes AS (
  SELECT n.*, u.updated_ts, CASE WHEN confidence >= 0.8 THEN 'promoted' ELSE 'provisional' END AS status FROM (
    SELECT concat('n_c',c_custkey) AS id,'Person' AS type,c_name AS title, CASE WHEN c_acctbal>0 THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM customer
    UNION ALL SELECT concat('n_s',s_suppkey),'Company',s_name,0.7::DOUBLE FROM supplier
    UNION ALL SELECT concat('n_p',p_partkey),'Product',p_name,0.6::DOUBLE FROM part
    UNION ALL SELECT concat('n_n',n_nationkey),'Location',n_name,0.9::DOUBLE FROM nation) n
  LEFT JOIN (SELECT concat('n_c',o_custkey) AS id, max(o_orderdate) AS updated_ts FROM orders GROUP BY 1) u USING (id))"""

EDGES = """edges AS (
  SELECT *, concat('e_', substr(md5(src_id||'|'||type||'|'||dst_id),1,26)) AS id FROM (
    SELECT concat('n_c',c_custkey) AS src_id, concat('n_n',c_nationkey) AS dst_id,'member_of' AS type, 0.7::DOUBLE AS weight FROM customer
    UNION ALL SELECT concat('n_s',s_suppkey),concat('n_n',s_nationkey),'member_of',0.7::DOUBLE FROM supplier
    UNION ALL SELECT concat('n_c',o_custkey),concat('n_p',l_partkey),'related_to', CASE WHEN count(*)>=10 THEN 1.0::DOUBLE ELSE count(*)/10.0::DOUBLE END
    FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY o_custkey,l_partkey))"""

ALIASES = (
    NODES
    + """, aliases AS (
  SELECT *, concat('a_', substr(md5(node_id||'|'||alias||'|'||source),1,26)) AS id, lower(trim(strip_accents(alias))) AS alias_key FROM (
    SELECT id AS node_id, title AS alias, 'seed' AS source, 1.0::DOUBLE AS weight FROM nodes
    UNION ALL SELECT node_id, alias, 'span', 0.5::DOUBLE FROM (SELECT DISTINCT id AS node_id, unnest(string_split(title,' ')) AS alias FROM nodes WHERE type='Product')))"""
)

EVIDENCE = """evidence AS (
  SELECT concat('v_',o_orderkey) AS id, 'node' AS subject_kind, concat('n_c',o_custkey) AS subject_id, o_orderkey AS msg_id, o_orderdate AS created_ts FROM orders)"""

TASKS = """tasks AS (
  SELECT o_custkey AS owner, o_orderkey AS seq, concat('Order ', o_orderkey%97) AS name, lower(substr(o_orderpriority,3)) AS importance,
         CASE WHEN o_orderkey%11=0 THEN NULL ELSE strftime(o_orderdate,'%Y-%m-%d') END AS date,
         CASE WHEN o_orderkey%3=0 THEN NULL ELSE concat(lpad(CAST(o_orderkey%24 AS VARCHAR),2,'0'),':00') END AS start,
         CAST(NULL AS VARCHAR) AS "end", ['status ' || o_orderstatus] AS updates
  FROM orders)"""

FACTS = """facts AS (
  SELECT user_id AS owner, event_type AS key, concat('k', json_extract_string(props,'$.k')) AS fact, event_id AS pos FROM events)"""

VECTORS = """vectors AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, make_timestamp(1704067200000000 + vec_id*3600000000) AS start_ts,
         md5(CAST(label AS VARCHAR)) AS hash, concat('chunk ', vec_id) AS chunk_text, CAST(label AS BIGINT) AS label FROM embeddings)"""

SHOWN = "CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE role END"


def sentences(col: str) -> str:
    cut = rf"regexp_replace(regexp_replace({col},'([.!?])\s+','\1'||chr(1),'g'),'([。！？])\s*','\1'||chr(1),'g')"
    return rf"list_filter(string_split({cut},chr(1)), lambda s: regexp_matches(s,'\S'))"


TRIMMED = r"regexp_replace({0},'^\s+|\s+$','','g')"

SENTS = (
    MSG
    + rf""", sents0 AS (
  SELECT session_id, id, ts, {SHOWN} AS role, {sentences(TRIMMED.format('content'))} AS l FROM messages WHERE role IN ('user','assistant')),
sents AS (SELECT session_id, id, ts, generate_subscripts(l,1)-1 AS pos, role, role || ': ' || unnest(l) AS text FROM sents0),
numbered AS (
  SELECT *, length(text) AS len, row_number() OVER (PARTITION BY session_id ORDER BY ts,id,pos)-1 AS n,
         sum(length(text)) OVER (PARTITION BY session_id ORDER BY ts,id,pos) AS upto FROM sents)"""
)


def chunks(size: int = 200, overlap: int = 50) -> str:
    """Recursive follow of start -> next start, from prefix sums of sentence lengths."""
    return (
        "RECURSIVE "
        + SENTS
        + f""", ends AS (
  SELECT a.session_id, a.n AS i, greatest(max(b.n) FILTER (WHERE b.upto - a.upto + a.len <= {size}), a.n)+1 AS j, max(b.n)+1 AS cnt
  FROM numbered a JOIN numbered b ON a.session_id=b.session_id AND b.n>=a.n GROUP BY a.session_id, a.n),
steps AS (
  SELECT e.session_id, e.i, e.j, e.cnt, greatest(e.i+1, coalesce(max(m.n) FILTER (WHERE p.upto - m.upto + m.len >= {overlap}), 0)) AS nxt
  FROM ends e JOIN numbered p ON p.session_id=e.session_id AND p.n=e.j-1
  JOIN numbered m ON m.session_id=e.session_id AND m.n<=e.j-1 GROUP BY e.session_id, e.i, e.j, e.cnt),
chain AS (
  SELECT session_id, 0::BIGINT AS chunk_ord, i, j, nxt, cnt FROM steps WHERE i=0
  UNION ALL SELECT s.session_id, c.chunk_ord+1, s.i, s.j, s.nxt, s.cnt FROM chain c JOIN steps s ON s.session_id=c.session_id AND s.i=c.nxt WHERE c.j < c.cnt),
members AS (
  SELECT c.session_id, c.chunk_ord, c.i, c.j, s.n, s.ts, s.text, s.len,
         s.n=c.i OR s.ts - lag(s.ts) OVER (PARTITION BY c.session_id, c.chunk_ord ORDER BY s.n) >= INTERVAL 5 MINUTE AS stamped
  FROM chain c JOIN numbered s ON s.session_id=c.session_id AND s.n>=c.i AND s.n<c.j),
raw_chunks AS (
  SELECT session_id, chunk_ord, min(ts) AS start_ts, min(n) AS first, max(n) AS last, CAST(sum(len) AS BIGINT) AS chars,
         string_agg(CASE WHEN stamped THEN strftime(ts,'[%y%m%d%a %H:%M] ') || text ELSE text END, chr(10) ORDER BY n) AS raw_text
  FROM members GROUP BY 1,2)"""
    )


def concat_roles(src: str, key: str, text: str, out: str = "joined", roles: str = "User|Assistant") -> str:
    """CTE ``out(key, t)``: consecutive lines of one role merged, from ``src``."""
    stamp = r"\[\d{6}\w{3} \d{2}:\d{2}\]"
    return rf"""{out}_l AS (
  SELECT {key}, unnest(l) AS line, generate_subscripts(l,1) AS i FROM (SELECT {key}, string_split({TRIMMED.format(text)}, chr(10)) AS l FROM {src})),
{out}_k AS (
  SELECT *, CASE WHEN regexp_matches(line,'^{stamp}\s*({roles}):') THEN 's' WHEN regexp_matches(line,'^{stamp}\s*$') THEN 'l'
                 WHEN regexp_matches(line,'^({roles}):') THEN 'p' ELSE 'o' END AS kind FROM {out}_l),
{out}_r AS (
  SELECT *, CASE kind WHEN 's' THEN regexp_extract(line,'^{stamp}\s*({roles}):',1) WHEN 'p' THEN regexp_extract(line,'^({roles}):',1) WHEN 'l' THEN '' END AS role FROM {out}_k),
{out}_p AS (
  SELECT *, coalesce(last_value(role IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),'') AS prev FROM {out}_r),
{out}_g AS (
  SELECT *, sum(CASE WHEN kind IN ('s','l') OR (kind='p' AND role<>prev) OR (kind='o' AND prev='') THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS g,
         CASE kind WHEN 's' THEN regexp_extract(line,'^{stamp}\s*({roles}):\s*(.*)$',2) WHEN 'p' THEN regexp_extract(line,'^({roles}):\s*(.*)$',2) ELSE line END AS part,
         CASE kind WHEN 's' THEN regexp_extract(line,'^({stamp})',1) || ' ' || role || ':' WHEN 'p' THEN role || ':' END AS prefix FROM {out}_p),
{out}_t AS (
  SELECT {key}, g, CASE WHEN first(prefix ORDER BY i) IS NULL THEN first(line ORDER BY i)
     ELSE regexp_replace(first(prefix ORDER BY i) || ' ' || coalesce(string_agg(part, chr(10) ORDER BY i) FILTER (WHERE part<>''),''),'\s+$','') END AS t
  FROM {out}_g GROUP BY {key}, g),
{out} AS (SELECT {key}, string_agg(t, chr(10) ORDER BY g) AS t FROM {out}_t GROUP BY {key})"""


def simhash(src: str, key: str, text: str, out: str = "sims") -> str:
    """CTE ``out(key, sim UBIGINT)``: 64-bit similarity hash over character bigrams, md5 prefix as bigram hash."""
    return f"""{out}_b AS (
  SELECT {key}, b, count(*) AS c FROM (
    SELECT {key}, unnest(list_transform(range(1, length({text})), lambda i: substr({text}, i, 2))) AS b FROM {src}) GROUP BY {key}, b),
{out}_h AS (SELECT b, ('0x'||substr(md5(b),1,16))::UBIGINT AS h FROM (SELECT DISTINCT b FROM {out}_b)),
{out}_v AS (
  SELECT {key}, i, sum(CASE WHEN ((h >> i) & 1::UBIGINT) = 1 THEN c ELSE -c END) AS v
  FROM {out}_b JOIN {out}_h USING (b), (SELECT unnest(range(0,64))::UBIGINT AS i) GROUP BY {key}, i),
{out}_s AS (SELECT {key}, sum(CASE WHEN v>0 THEN (1::HUGEINT << i::INT) ELSE 0 END)::UBIGINT AS sim FROM {out}_v GROUP BY {key}),
{out} AS (SELECT r.{key}, coalesce(s.sim, 0::UBIGINT) AS sim FROM {src} r LEFT JOIN {out}_s s USING ({key}))"""


HEX64 = "lpad(lower(to_hex({0})),16,'0')"
