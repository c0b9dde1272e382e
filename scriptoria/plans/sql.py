"""SQL fragments the oracle queries share: the adapter tables as CTEs."""

WORD = r"[\p{L}\p{N}_/*()=+|&'']+(?:\.?[\p{L}\p{N}_/*()=+|&'']+)*"
PLAIN_WORD = r"[\p{L}\p{N}_]+"

WORKS = """works AS (
  SELECT DISTINCT source AS title, source || '-' || lang AS title_slug, lang AS language,
         'Author of ' || source AS author, 'Editor ' || lang AS editor FROM documents)"""

DIVISIONS = """divisions AS (
  SELECT d.doc_id AS division_id, source || '-' || lang AS work_slug, d.doc_id AS sequence_number,
         CAST(d.doc_id AS VARCHAR) AS descriptor, coalesce(quality, 0) = 1 AS readable_unit
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

VERSES = """verses AS (
  SELECT doc_id * 67108864 + line AS verse_id, doc_id AS division_id, line + 1 AS sequence_number,
         CAST(line + 1 AS VARCHAR) AS indicator, work_slug, lang AS language, content
  FROM (SELECT doc_id, lang, source || '-' || lang AS work_slug, unnest(parts) AS content,
               unnest(range(len(parts))) AS line
        FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents)))"""

POSTINGS = f"""postings AS (
  SELECT field, term, verse_id, work_slug, count(*) AS tf FROM (
    SELECT 'content' AS field, verse_id, work_slug,
           unnest(regexp_extract_all(lower(content), '{WORD}')) AS term FROM verses
    UNION ALL
    SELECT 'no_diacritics', verse_id, work_slug,
           unnest(regexp_extract_all(lower(strip_accents(content)), '{WORD}')) FROM verses)
  GROUP BY ALL)"""

TOKENS = f"""tokens AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{PLAIN_WORD}')) AS token FROM documents)"""

GEOGRAPHY = """geography AS (
  SELECT *, row_number() OVER (ORDER BY a, b, c) AS sequence_number FROM (
    SELECT r_regionkey + 1 AS division_id, NULL AS parent_id, r_name AS descriptor, 'Region' AS type, 1 AS level,
           false AS readable_unit, r_regionkey AS a, -1 AS b, -1 AS c FROM region
    UNION ALL
    SELECT n_nationkey + 1001, n_regionkey + 1, n_name, 'Nation', 2, false, n_regionkey, n_nationkey, -1 FROM nation
    UNION ALL
    SELECT c_custkey + 100001, c_nationkey + 1001, c_name, 'Customer', 3, true, n_regionkey, c_nationkey, c_custkey
    FROM customer JOIN nation ON c_nationkey = n_nationkey))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
