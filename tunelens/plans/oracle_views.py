"""The fixture views of :mod:`tunelens.plans.fixtures`, stated as common table expressions."""

EVENTS = """
ev AS (SELECT event_id, event_id // 5000 AS app, event_id // 100 AS job,
  2 * (event_id // 100) + event_id % 2 AS stage, CAST(user_id % 8 AS VARCHAR) AS executor,
  epoch_us(ts) // 1000 AS launch, epoch_us(ts) // 1000 + CAST(round(value * 10) AS BIGINT) AS finish,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events),
st AS (SELECT app, job, stage, count(*) AS n, min(launch) AS first, max(finish) AS last FROM ev GROUP BY 1, 2, 3),
jb AS (SELECT app, job, min(first) AS submission FROM st GROUP BY 1, 2),
ap AS (SELECT app, min(first) AS start, max(last) AS last FROM st GROUP BY 1),
tk AS (SELECT 'app-' || app AS app_id, event_id AS task_id, stage AS stage_id, executor AS executor_id,
  launch AS launch_ms, CASE WHEN k % 3 = 0 THEN 'NODE_LOCAL' ELSE 'PROCESS_LOCAL' END AS locality,
  CASE WHEN event_id % 97 <> 0 THEN finish END AS finish_ms,
  CASE WHEN event_id % 97 <> 0 THEN CASE WHEN event_type = 'error' THEN 'ExceptionFailure' ELSE 'Success' END END
    AS end_reason,
  CASE WHEN event_id % 97 <> 0 THEN k END AS k FROM ev),
js AS (SELECT 'app-' || app AS app_id, job AS job_id, stage AS stage_id, 'stage ' || stage AS name,
  CASE WHEN stage % 2 = 1 AND job % 11 = 0 THEN 0 ELSE n END AS num_tasks, first AS submission_ms,
  last AS completion_ms FROM st),
jo AS (SELECT 'app-' || app AS app_id, job AS job_id, submission AS submission_ms,
  submission + 1000 + 7 * (job % 50) AS end_ms,
  CASE WHEN job % 17 = 0 THEN 'JobFailed' ELSE 'JobSucceeded' END AS result FROM jb),
ex AS (SELECT 'app-' || app AS app_id, CAST(x AS VARCHAR) AS executor_id, 'h' || x AS host,
  CAST(1 + x % 4 AS BIGINT) AS cores, start AS start_ms, CASE WHEN x = 7 THEN start + 60000 END AS remove_ms,
  CASE WHEN x = 7 THEN 'lost' END AS remove_reason FROM ap, range(8) r(x))
"""


def metrics(name: str = "m", batches: int = 20) -> str:
    """Per-batch metrics in percent."""
    return f"""
{name}_f AS (SELECT CAST(l_suppkey % 9 + 1 AS INTEGER) AS exp, CAST(l_partkey % 32 AS INTEGER) AS hp_idx,
  l_orderkey % {batches} AS batch, CAST(sum(l_quantity) AS BIGINT) AS instances,
  round(0.5 + 4 * avg(l_discount), 6) AS accuracy, round(0.95 - 4 * avg(l_tax), 6) AS recall,
  round(0.5 + 3 * avg(l_discount), 6) AS precision FROM lineitem GROUP BY 1, 2, 3),
{name} AS (SELECT exp, hp_idx, batch, instances, round(accuracy * 100, 6) AS accuracy,
  round(recall * 100, 6) AS recall, round(precision * 100, 6) AS precision,
  round(round(2 * precision * recall / (precision + recall), 6) * 100, 6) AS f1 FROM {name}_f)"""


TIMES = """
t AS (SELECT CAST(l_suppkey % 9 + 1 AS INTEGER) AS exp, CAST(l_partkey % 32 AS INTEGER) AS hp_idx,
  count(DISTINCT l_orderkey % 20) AS jobs, CAST(sum(l_quantity * (8 + l_linenumber % 5)) AS BIGINT) AS job_ms, count(*) AS tasks,
  CAST(round(sum(l_extendedprice) / 100) AS BIGINT) AS task_ms, CAST(max(l_linenumber) AS INTEGER) AS depth
  FROM lineitem GROUP BY 1, 2)"""

SUMMARY = """
s AS (SELECT exp, hp_idx, CAST(sum(instances) AS BIGINT) AS instances, round(avg(accuracy), 9) AS accuracy,
  round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision, round(avg(f1), 9) AS f1
  FROM m GROUP BY 1, 2)"""

CUBE = """
c AS (SELECT s.*, jobs, job_ms, tasks, task_ms, round(1000.0::DOUBLE * instances / job_ms, 6) AS throughput,
  round(2.0::DOUBLE * task_ms / tasks, 6) AS latency FROM s JOIN t USING (exp, hp_idx))"""


def norm(column: str, smaller: bool = False, over: str = "OVER ()") -> str:
    low, high = f"min({column}) {over}", f"max({column}) {over}"
    part = f"({high} - {column})" if smaller else f"({column} - {low})"
    return f"{part} / nullif(CAST({high} - {low} AS DOUBLE), 0) * 100 AS norm_{column}"


NORM_CUBE = f"""
n0 AS (SELECT *, {", ".join(norm(c) for c in ("accuracy", "recall", "precision", "f1", "throughput"))},
  {", ".join(norm(c, True) for c in ("job_ms", "task_ms", "latency"))} FROM c),
n AS (SELECT *, (norm_job_ms + norm_task_ms) / 2 AS norm_joined_time FROM n0)"""

LAST_HALF = """
lh0 AS (SELECT exp, hp_idx, accuracy, row_number() OVER (PARTITION BY exp, hp_idx ORDER BY batch) AS no,
  count(*) OVER (PARTITION BY exp, hp_idx) AS n FROM m),
lh AS (SELECT exp, hp_idx, round(avg(accuracy) FILTER (no > n // 2), 9) AS last_half_accuracy
  FROM lh0 GROUP BY 1, 2)"""

SINGLE = """
r AS (SELECT exp, hp_idx, oa AS overall_accuracy, f1, last_half_accuracy AS accuracy,
  round(CAST(job_ms AS DOUBLE) / jobs, 6) AS job_ms, CAST((200 * task_ms + tasks) // (2 * tasks) AS DOUBLE) / 100 AS task_ms, depth
  FROM (SELECT exp, hp_idx, accuracy AS oa, f1 FROM s) JOIN lh USING (exp, hp_idx) JOIN t USING (exp, hp_idx))"""

INSTANCES = """
i0 AS (SELECT event_id AS id, value AS f_value, CAST(hour(ts) AS DOUBLE) AS f_hour,
  CAST(user_id % 10 AS DOUBLE) AS f_user, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS f_k,
  event_type AS f_type FROM events),
i AS (SELECT *, CAST((f_value + f_k > 100) <> (id % 10 = 0) AS INTEGER) AS label,
  CASE WHEN f_value + f_k < 60 THEN 0 WHEN f_value + f_k < 120 THEN 1 ELSE 2 END AS label3 FROM i0)"""

TWEETS = """
w AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'RT @user ' ELSE '' END || text
  || CASE WHEN doc_id % 3 = 0 THEN ' #topic' || doc_id % 10 ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN ' SEE https://example.org/' || doc_id ELSE '' END AS text,
  n_chars AS cntPosts, doc_id % 7 AS cntLists, doc_id % 1000 AS cntFollowers, doc_id % 300 AS cntFriends,
  doc_id % 3650 AS accountAge,
  CASE WHEN toxic = 1 THEN 'abusive' WHEN quality = 0 THEN 'spam' WHEN toxic = 0 THEN 'normal' END AS class
  FROM documents LEFT JOIN labels USING (doc_id))"""
