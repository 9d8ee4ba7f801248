"""The same questions in plain SQL, over the same tables, for an independent check."""

SPACES = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def _outline(many: bool, lead: bool) -> str:
    source = "n_name" if many else "'all'"
    platform = (
        "SELECT r_regionkey, n_nationkey, -1, -1, 1, n_name, "
        "substr('一二三四五六七八九十', r_regionkey + 1, 1), r_name FROM systems"
        if many
        else "SELECT r_regionkey, -1, -1, -1, 1, 'all', "
        "substr('一二三四五六七八九十', r_regionkey + 1, 1), r_name FROM region"
    )
    leads = ""
    if lead:
        owner = (
            "r_regionkey, n_nationkey, -1, -2, place, n_name, serial, title FROM systems,"
            if many
            else "0, -1, -1, -2, place, 'all', serial, title FROM"
        )
        leads = f"""
  UNION ALL SELECT {owner} (VALUES (0, '（十）', 'system without platform'),
    (1, '0', 'software without platform'), (2, '（１）', 'module of  unplaced software'))
    AS lead_rows(place, serial, title)"""
    return f"""
systems AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
outline(r, n, s, p, place, source_id, serial, name) AS (
  {platform}
  UNION ALL SELECT r_regionkey, n_nationkey, -1, -1, 2, {source},
    '（' || substr('一二三四五六七八九十', n_nationkey % 10 + 1, 1) || '）', n_name FROM systems
  UNION ALL SELECT r_regionkey, n_nationkey, s_suppkey, -1, 8, {source},
    (s_suppkey + 1)::VARCHAR, s_name FROM supplier JOIN systems ON s_nationkey = n_nationkey
  UNION ALL SELECT r_regionkey, n_nationkey, s_suppkey, p_partkey, 9, {source},
    '（' || (p_partkey + 1)::VARCHAR || '）', p_name
    FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
    JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN systems ON s_nationkey = n_nationkey
  UNION ALL SELECT r_regionkey, n_nationkey, -1, -1, place, {source}, serial,
    CASE WHEN place <> 6 THEN prefix || n_name END
    FROM systems, (VALUES (3, NULL, 'category '), (4, '（9）', 'orphan '), (5, 'x-1', 'unknown '),
      (6, '7', NULL), (7, '合 计', 'sum of ')) AS extra(place, serial, prefix){leads}
),
sheet AS (
  SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY r, n, s, p, place) + 2
    AS row_number, serial, name FROM outline
  UNION ALL SELECT DISTINCT source_id, 1, NULL, 'inventory' FROM outline
  UNION ALL SELECT DISTINCT source_id, 2, '序号', ' 应用系统名称 ' FROM outline
),
cleaned AS (
  SELECT source_id, row_number,
    regexp_replace(translate(coalesce(serial, ''), '（）１', '()1'), '\\s+', '', 'g') AS serial,
    trim(regexp_replace(coalesce(name, ''), '\\s+', ' ', 'g')) AS name
  FROM sheet
),
headers AS (
  SELECT source_id, min(row_number) AS header_row FROM cleaned
  WHERE row_number <= 30 AND serial = '序号' AND name = '应用系统名称' GROUP BY source_id
),
kept AS (
  SELECT c.* FROM cleaned c JOIN headers h ON c.source_id = h.source_id
  WHERE c.row_number > h.header_row AND NOT (serial = '' AND name = '')
    AND serial <> '合计' AND name <> '合计'
),
levelled AS (
  SELECT *, CASE WHEN name = '' THEN 'nameless' WHEN serial = '' THEN 'category'
    WHEN regexp_full_match(serial, '[零〇一二三四五六七八九十百千万两]+') THEN 'platform'
    WHEN regexp_full_match(serial, '\\([零〇一二三四五六七八九十百千万两]+\\)') THEN 'system'
    WHEN regexp_full_match(serial, '\\d+') THEN 'software'
    WHEN regexp_full_match(serial, '\\(\\d+\\)') THEN 'module' ELSE 'unknown' END AS level
  FROM kept
)"""


def _states(many: bool, lead: bool) -> str:
    return f"""{_outline(many, lead)},
marked AS (
  SELECT *,
    coalesce(max(CASE WHEN level = 'platform' THEN row_number END) OVER w, 0) AS pr,
    coalesce(max(CASE WHEN level = 'system' THEN row_number END) OVER w, 0) AS sr,
    coalesce(max(CASE WHEN level = 'software' THEN row_number END) OVER w, 0) AS wr,
    count(*) FILTER (level = 'platform') OVER w AS np,
    count(*) FILTER (level = 'system') OVER w AS ns,
    count(*) FILTER (level = 'software') OVER w AS nw
  FROM levelled
  WINDOW w AS (PARTITION BY source_id ORDER BY row_number ROWS UNBOUNDED PRECEDING)
),
flagged AS (
  SELECT *, pr > 0 AS has_p, sr > pr AS has_s, wr > greatest(pr, sr) AS has_w FROM marked
),
numbered AS (
  SELECT *, count(*) FILTER (level = 'module' AND has_w) OVER (
    PARTITION BY source_id ORDER BY row_number ROWS UNBOUNDED PRECEDING) AS nm
  FROM flagged
),
states AS (
  SELECT f.source_id, f.row_number, f.serial, f.name, f.level,
    CASE WHEN has_p THEN printf('P%03d', np) ELSE '' END AS platform_id,
    CASE WHEN has_p THEN p.name ELSE '' END AS platform_name,
    CASE WHEN has_s THEN printf('S%03d', ns) ELSE '' END AS system_id,
    CASE WHEN has_s THEN s.name ELSE '' END AS system_name,
    CASE WHEN has_w THEN printf('SW%03d', nw) ELSE '' END AS software_id,
    CASE WHEN has_w THEN w.name ELSE '' END AS software_name,
    CASE WHEN f.level = 'module' AND has_w THEN printf('M%04d', nm) ELSE '' END AS module_id,
    CASE WHEN f.level = 'module' AND has_w THEN f.name ELSE '' END AS module_name
  FROM numbered f
  LEFT JOIN levelled p ON p.source_id = f.source_id AND p.row_number = f.pr
  LEFT JOIN levelled s ON s.source_id = f.source_id AND s.row_number = f.sr
  LEFT JOIN levelled w ON w.source_id = f.source_id AND w.row_number = f.wr
),
issues AS (
  SELECT source_id, row_number, CASE
    WHEN level = 'nameless' THEN '序号 ''' || serial || ''' 对应的名称为空，已跳过'
    WHEN level = 'system' AND platform_id = '' THEN '系统行缺少当前平台'
    WHEN level = 'software' AND (platform_id = '' OR system_id = '') THEN '软件行缺少当前平台或系统'
    WHEN level = 'module' AND module_id = '' THEN '模块行缺少当前软件，已跳过'
    WHEN level = 'unknown' THEN '无法识别序号格式 ''' || serial || '''，已跳过' END AS problem
  FROM states
)"""


RECORD = (
    "platform_id, platform_name, system_id, system_name, software_id, software_name, "
    "module_id, module_name"
)


def _records(many: bool, lead: bool) -> str:
    group = "source_id" if many else "'A'"
    return f"""{_states(many, lead)},
records AS (
  SELECT {group} AS group_id, {RECORD},
    row_number() OVER (ORDER BY source_id, row_number) AS input_seq
  FROM states WHERE level = 'software' OR module_id <> ''
)"""


def _objects(many: bool) -> str:
    return f"""{_records(many, False)},
objects AS (
  SELECT 'software' AS level, software_id AS object_id, software_name AS name, group_id,
    any_value(platform_id) AS platform_id, any_value(platform_name) AS platform_name,
    any_value(system_id) AS system_id, any_value(system_name) AS system_name, software_id,
    any_value(software_name) AS software_name, '' AS module_id, '' AS module_name,
    min(input_seq) AS obj_seq
  FROM records GROUP BY group_id, software_id, software_name
  UNION ALL
  SELECT 'module', module_id, module_name, group_id, any_value(platform_id),
    any_value(platform_name), any_value(system_id), any_value(system_name), any_value(software_id),
    any_value(software_name), module_id, module_name, min(input_seq)
  FROM records WHERE module_id <> '' GROUP BY group_id, module_id, module_name
)"""


VECTORS = """
items AS (
  SELECT lpad(vec_id::VARCHAR, 10, '0') AS id, label::VARCHAR AS grp, vec_id AS seq,
    embedding::DOUBLE[] AS v, min(vec_id) OVER (PARTITION BY label) AS first_seq
  FROM embeddings
)"""


def vector_matches(condition: str, threshold: float, top_k: int) -> str:
    return f"""{VECTORS},
scored AS (
  SELECT a.id AS a_id, b.id AS b_id, a.grp AS a_group, b.grp AS b_group,
    list_cosine_similarity(a.v, b.v) AS score
  FROM items a JOIN items b ON {condition}
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_group, b_id) AS rnk
  FROM scored WHERE score + 1e-7 >= {threshold}
  QUALIFY rnk <= {top_k}
)"""


WITHIN = "a.grp = b.grp AND a.seq < b.seq"
CROSS = "a.first_seq < b.first_seq"
ALL = f"({CROSS}) OR ({WITHIN})"


def directed(anchor: str, targets: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in targets)
    return f"a.grp = '{anchor}' AND b.grp IN ({listed})"


PAIR_COLUMNS = "a_group, a_id, b_group, b_id, rnk::INT AS rnk, round(score, 6) AS score"


def vector_query(condition: str, threshold: float, top_k: int) -> str:
    return f"WITH {vector_matches(condition, threshold, top_k)} SELECT {PAIR_COLUMNS} FROM ranked"


def unmatched_query(condition: str, scope: str, threshold: float, top_k: int) -> str:
    return f"""WITH {vector_matches(condition, threshold, top_k)}
SELECT a.grp AS a_group, a.id AS a_id, b_group, b_id, coalesce(rnk, 0)::INT AS rnk,
  round(score, 6) AS score, CASE WHEN rnk IS NULL THEN '无匹配' WHEN score >= 0.9 THEN '极高相似'
    WHEN score >= 0.85 THEN '高相似' WHEN score >= 0.75 THEN '中等相似' ELSE '低相似' END AS label
FROM items a LEFT JOIN ranked ON a_id = a.id WHERE {scope}"""


def gram_pairs(source: str, threshold: float) -> str:
    """Cosine of 3-gram counts between the distinct names of ``source(name)``."""
    return f"""
names AS (SELECT DISTINCT name FROM {source}),
gram_counts AS (
  SELECT name, gram, count(*)::DOUBLE AS c FROM (
    SELECT name, unnest(CASE WHEN length(name) < 3 THEN [name]
      ELSE list_transform(range(1, length(name) - 1), lambda i: substr(name, i, 3)) END) AS gram
    FROM names)
  GROUP BY name, gram
),
lengths AS (SELECT name, sum(c * c) AS sq FROM gram_counts GROUP BY name),
name_pairs AS (
  SELECT a_name, b_name, round(dot / sqrt(a.sq * b.sq), 12) AS score FROM (
    SELECT x.name AS a_name, y.name AS b_name, sum(x.c * y.c) AS dot
    FROM gram_counts x JOIN gram_counts y ON x.gram = y.gram GROUP BY x.name, y.name)
  JOIN lengths a ON a.name = a_name JOIN lengths b ON b.name = b_name
  WHERE dot / sqrt(a.sq * b.sq) + 1e-7 >= {threshold}
)"""


LABEL = """CASE WHEN a_name = b_name THEN '名称完全相同' WHEN score >= 0.9 THEN '极高相似'
  WHEN score >= 0.85 THEN '高相似' WHEN score >= 0.75 THEN '中等相似' ELSE '低相似' END"""

PARTS = """
parts AS (
  SELECT lpad(p_partkey::VARCHAR, 10, '0') AS id, p_brand AS grp, lower(p_name) AS name,
    p_partkey AS seq, min(p_partkey) OVER (PARTITION BY p_brand) AS first_seq
  FROM part
)"""


SUPPLIERS = """
parts AS (
  SELECT lpad(s_suppkey::VARCHAR, 10, '0') AS id, s_nationkey::VARCHAR AS grp,
    lower(s_name) AS name, s_suppkey AS seq,
    min(s_suppkey) OVER (PARTITION BY s_nationkey) AS first_seq
  FROM supplier
)"""


def part_matches(condition: str, pairs: str, top_k: int, parts: str = PARTS) -> str:
    return f"""{parts}, {pairs},
ranked AS (
  SELECT a.id AS a_id, b.id AS b_id, a.grp AS a_group, b.grp AS b_group, a_name, b_name, score,
    row_number() OVER (PARTITION BY a.id ORDER BY score DESC, b.grp, b.id) AS rnk
  FROM parts a JOIN name_pairs ON a_name = a.name JOIN parts b ON b.name = b_name AND {condition}
  QUALIFY rnk <= {top_k}
)"""


LETTER_PAIRS = """
names AS (SELECT DISTINCT name FROM parts),
letters AS (
  SELECT name, list_transform(range(97, 123),
    lambda c: (length(name) - length(replace(name, chr(c::INT), '')))::DOUBLE) AS v
  FROM names
),
name_pairs AS (
  SELECT a.name AS a_name, b.name AS b_name, round(list_cosine_similarity(a.v, b.v), 12) AS score
  FROM letters a JOIN letters b ON list_cosine_similarity(a.v, b.v) + 1e-7 >= {threshold}
)"""


def sheet_matches(condition: str, threshold: float, top_k: int) -> str:
    """Matches of both levels over the objects of the sheets per nation."""
    return f"""{_objects(True)},
ordered AS (
  SELECT *, lower(name) AS norm,
    min(obj_seq) OVER (PARTITION BY level, group_id) AS first_seq FROM objects
),
source_names AS (SELECT DISTINCT norm AS name FROM ordered),
{gram_pairs('source_names', threshold)},
ranked AS (
  SELECT a.level, a.group_id AS a_group, a.object_id AS a_id, b.group_id AS b_group,
    b.object_id AS b_id, a_name, b_name, score, row_number() OVER (
      PARTITION BY a.level, a.group_id, a.object_id
      ORDER BY score DESC, b.group_id, b.object_id) AS rnk
  FROM ordered a JOIN name_pairs ON a_name = a.norm
  JOIN ordered b ON b.norm = b_name AND a.level = b.level AND {condition}
  QUALIFY rnk <= {top_k}
)"""


SIDE_HEADERS = [
    ("group_id", "组编号"),
    ("platform_id", "平台编号"),
    ("platform_name", "平台名称"),
    ("system_id", "系统编号"),
    ("system_name", "系统名称"),
    ("software_id", "软件编号"),
    ("software_name", "软件名称"),
    ("module_id", "模块编号"),
    ("module_name", "模块名称"),
]


def sheet_result_table(condition: str, scope: str, threshold: float, top_k: int) -> str:
    a_side = ", ".join(f'a.{c} AS "A{h}"' for c, h in SIDE_HEADERS)
    b_side = ", ".join(f"coalesce(b.{c}, '') AS \"B{h}\"" for c, h in SIDE_HEADERS)
    return f"""WITH {sheet_matches(condition, threshold, top_k)}
SELECT row_number() OVER (ORDER BY CASE a.level WHEN 'software' THEN 0 ELSE 1 END,
    a.group_id, a.object_id, coalesce(rnk, 0)) AS "序号",
  a.level AS "比较层级", coalesce(rnk, 0)::INT AS "相似度排名",
  round(score, 6) AS "BGE-M3余弦相似度",
  CASE WHEN rnk IS NULL THEN '无匹配' ELSE {LABEL} END AS "相似等级", {a_side}, {b_side}
FROM ordered a
LEFT JOIN ranked m ON m.level = a.level AND m.a_group = a.group_id AND m.a_id = a.object_id
LEFT JOIN ordered b ON b.level = m.level AND b.group_id = m.b_group AND b.object_id = m.b_id
WHERE {scope}"""


def counts_select() -> str:
    return """SELECT s.source_id, count(*) FILTER (level = 'platform') AS platform,
  count(*) FILTER (level = 'system') AS system, count(*) FILTER (level = 'software') AS software,
  count(*) FILTER (module_id <> '') AS module,
  count(*) FILTER (level = 'category') AS excluded_categories,
  count(*) FILTER (level = 'software' OR module_id <> '') AS output_rows,
  count(problem) AS warnings
FROM states s JOIN issues i ON s.source_id = i.source_id AND s.row_number = i.row_number
GROUP BY s.source_id"""


def outline_sql(many: bool, lead: bool) -> str:
    return "WITH " + _outline(many, lead)


def states_sql(many: bool, lead: bool) -> str:
    return "WITH " + _states(many, lead)


def records_sql(many: bool, lead: bool) -> str:
    return "WITH " + _records(many, lead)


def objects_sql(many: bool) -> str:
    return "WITH " + _objects(many)
