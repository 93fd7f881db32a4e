"""Tool-call messages derived from the `conversations` table, in Spark, and the same calls and results in plain SQL.

Each assistant turn becomes a call whose id, tool, arguments and dependencies follow from its place and the length of its
text; each user turn becomes the result of the turn before it. Some are made wrong on purpose: unknown tools and
ids, missing or mistyped arguments, dependency cycles, repeated ids. Texts go in whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOOLS = (
    ("search", '{"type":"object","properties":{"query":{"type":"string"},"limit":{"type":"integer","minimum":1,"maximum":40},'
               '"opts":{"type":"object"}},"required":["limit","query"],"additionalProperties":false}'),
    ("lookup", '{"type":"object","properties":{"query":{"type":"string"},"mode":{"type":"string","enum":["fast","deep"]}},"required":["query"]}'),
    ("rank", '{"type":"object","properties":{"limit":{"type":"number"},"query":{"type":"string"}},"required":["query"],"additionalProperties":false}'),
)


def tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOOLS), "name string, parameters string")


def messages(conversations: DataFrame) -> DataFrame:
    n, turn = F.length("text"), F.col("turn")
    quoted = lambda text: F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)
    call = lambda t: F.concat(F.lit('"c'), t.cast("string"), F.lit('"'))
    query = F.when(n % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(' "query" : '), quoted(F.col("text")), F.lit(",")))
    limit = F.when(n % 7 == 0, F.concat(F.lit('"'), (n % 50).cast("string"), F.lit('"'))).otherwise((n % 50).cast("string"))
    mode = F.when(n % 3 == 0, F.lit('"mode":"fast", ')).when(n % 3 == 1, F.lit('"mode":"slow", ')).otherwise(F.lit(""))
    arguments = F.concat(F.lit("{"), query, mode, F.lit('"limit": '), limit, F.lit(', "opts":{ "z":true,"a":'), turn.cast("string"), F.lit("} }"))
    after = (
        F.when(n % 11 == 0, F.concat(call(turn + 2), F.lit(","), call(turn - 2))).when(n % 3 == 0, call(turn - 2))
        .when(n % 3 == 2, F.concat(call(turn - 2), F.lit(", "), call(turn - 4))).otherwise(F.lit(""))
    )
    name = F.element_at(F.array(*map(F.lit, ("search", "lookup", "rank", "forget"))), (n % 4 + 1).cast("int"))
    number = F.when(n % 13 == 0, turn % 2).otherwise(turn)
    as_call = F.concat(
        F.lit('{"tool_calls": [{"name":"'), name, F.lit('", "id": "c'), number.cast("string"), F.lit('", "arguments": '), arguments,
        F.lit(', "after": ['), after, F.lit("]}]}"),
    )
    to = F.when(n % 6 == 0, F.concat(F.lit("x"), turn.cast("string"))).otherwise(F.concat(F.lit("c"), (turn - 1).cast("string")))
    as_result = F.concat(F.lit('{"tool_call_id": "'), to, F.lit('", "content": '), quoted(F.col("text")), F.lit("}"))
    role = F.when(F.col("role") == "user", F.lit("tool")).otherwise(F.col("role"))
    text = F.when(F.col("role") == "assistant", as_call).when(F.col("role") == "user", as_result).otherwise(F.col("text"))
    return conversations.where("text IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))


SQL = """
WITH RECURSIVE base AS (
  SELECT conv_id, turn, role, text, length(text) AS n, count(*) AS copies FROM conversations
  WHERE text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
calls AS (
  SELECT conv_id, turn, 0 AS call_index, 'c' || CAST(CASE WHEN n % 13 = 0 THEN turn % 2 ELSE turn END AS VARCHAR) AS call_id,
    CASE n % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' WHEN 2 THEN 'rank' ELSE 'forget' END AS name, text, n, copies,
    '{"limit":' || CASE WHEN n % 7 = 0 THEN '"' || CAST(n % 50 AS VARCHAR) || '"' ELSE CAST(n % 50 AS VARCHAR) END
      || CASE n % 3 WHEN 0 THEN ',"mode":"fast"' WHEN 1 THEN ',"mode":"slow"' ELSE '' END
      || ',"opts":{"a":' || CAST(turn AS VARCHAR) || ',"z":true}'
      || CASE WHEN n % 5 = 0 THEN '' ELSE ',"query":' || CAST(to_json(text) AS VARCHAR) END || '}' AS arguments
  FROM base WHERE role = 'assistant'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn) AS k FROM calls),
firsts AS (SELECT * FROM ranked WHERE k = 1),
wanted AS (
  SELECT conv_id, call_id, 'c' || CAST(turn + 2 AS VARCHAR) AS dep FROM firsts WHERE n % 11 = 0
  UNION SELECT conv_id, call_id, 'c' || CAST(turn - 2 AS VARCHAR) FROM firsts WHERE n % 11 = 0 OR n % 3 IN (0, 2)
  UNION SELECT conv_id, call_id, 'c' || CAST(turn - 4 AS VARCHAR) FROM firsts WHERE n % 11 <> 0 AND n % 3 = 2),
edges AS (SELECT w.* FROM wanted w JOIN firsts f ON f.conv_id = w.conv_id AND f.call_id = w.dep),
unknown AS (SELECT conv_id, call_id, count(*) AS unknown FROM (SELECT * FROM wanted EXCEPT SELECT * FROM edges) GROUP BY ALL),
reach AS (
  SELECT conv_id, call_id, dep FROM edges
  UNION SELECT r.conv_id, r.call_id, e.dep FROM reach r JOIN edges e ON e.conv_id = r.conv_id AND e.call_id = r.dep),
circles AS (SELECT DISTINCT conv_id, call_id FROM reach WHERE call_id = dep),
stuck AS (
  SELECT * FROM circles
  UNION SELECT r.conv_id, r.call_id FROM reach r JOIN circles c ON c.conv_id = r.conv_id AND c.call_id = r.dep),
steps AS (
  SELECT conv_id, call_id, CAST(0 AS BIGINT) AS level FROM firsts
  UNION SELECT e.conv_id, e.call_id, s.level + 1 FROM steps s JOIN edges e ON e.conv_id = s.conv_id AND e.dep = s.call_id
    WHERE NOT EXISTS (SELECT 1 FROM stuck x WHERE x.conv_id = e.conv_id AND x.call_id = e.call_id)),
leveled AS (
  SELECT s.conv_id, s.call_id, max(level) AS level FROM steps s
  WHERE NOT EXISTS (SELECT 1 FROM stuck x WHERE x.conv_id = s.conv_id AND x.call_id = s.call_id) GROUP BY ALL),
placed AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.level, f.turn, f.call_index, f.call_id) AS position
  FROM leveled l JOIN firsts f ON f.conv_id = l.conv_id AND f.call_id = l.call_id),
results AS (
  SELECT conv_id, turn, CASE WHEN n % 6 = 0 THEN 'x' || CAST(turn AS VARCHAR) ELSE 'c' || CAST(turn - 1 AS VARCHAR) END AS call_id,
    text AS content, copies FROM base WHERE role = 'user'),
answers AS (
  SELECT conv_id, call_id, turn AS result_turn, content, n_results FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, content) AS k,
      CAST(sum(copies) OVER (PARTITION BY conv_id, call_id) AS BIGINT) AS n_results FROM results) WHERE k = 1),
judged AS (
  SELECT r.conv_id, r.turn, r.call_index, r.call_id, r.name, r.k, r.copies, r.arguments, p.level, p.position, a.result_turn, a.n_results, a.content,
    coalesce(u.unknown, 0) AS unknown,
    CASE r.name WHEN 'forget' THEN 'unknown_tool' ELSE array_to_string(list_sort(list_filter([
      CASE WHEN r.n % 5 = 0 THEN 'missing:query' END,
      CASE WHEN r.n % 7 = 0 AND r.name <> 'lookup' THEN 'type:limit' END,
      CASE WHEN r.name = 'search' AND (r.n % 50 < 1 OR r.n % 50 > 40) THEN 'range:limit' END,
      CASE WHEN r.name = 'lookup' AND r.n % 3 = 1 THEN 'enum:mode' END,
      CASE WHEN r.name <> 'lookup' AND r.n % 3 <> 2 THEN 'unexpected:mode' END,
      CASE WHEN r.name = 'rank' THEN 'unexpected:opts' END], lambda x: x IS NOT NULL)), ',') END AS errors
  FROM ranked r LEFT JOIN placed p ON r.k = 1 AND p.conv_id = r.conv_id AND p.call_id = r.call_id
    LEFT JOIN answers a ON r.k = 1 AND a.conv_id = r.conv_id AND a.call_id = r.call_id
    LEFT JOIN unknown u ON r.k = 1 AND u.conv_id = r.conv_id AND u.call_id = r.call_id),
told AS (
  SELECT *, CASE WHEN unknown > 0 THEN CASE WHEN errors = '' THEN 'unknown_dependency' ELSE errors || ',unknown_dependency' END ELSE errors END AS said
  FROM judged)
SELECT conv_id, turn, CAST(call_index AS INT) AS call_index, call_id, name,
  CASE WHEN k > 1 THEN 'duplicate' WHEN level IS NULL THEN 'cycle' WHEN result_turn IS NULL THEN 'no_result'
       WHEN result_turn <= turn THEN 'result_before_call' ELSE 'ok' END AS status,
  level, position, result_turn, CASE WHEN k = 1 THEN coalesce(n_results, 0) END AS n_results, copies, said = '' AS valid, said AS errors,
  '{"arguments":' || arguments || ',"id":"' || call_id || '","name":"' || name || '","result":'
    || CASE WHEN content IS NULL THEN 'null' ELSE CAST(to_json(content) AS VARCHAR) END || '}' AS canonical
FROM told
UNION ALL
SELECT r.conv_id, r.turn, NULL, r.call_id, NULL, 'orphan_result', NULL, NULL, r.turn, NULL, r.copies, NULL, NULL,
  '{"content":' || CAST(to_json(r.content) AS VARCHAR) || ',"tool_call_id":"' || r.call_id || '"}'
FROM results r WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.conv_id = r.conv_id AND f.call_id = r.call_id)
"""
