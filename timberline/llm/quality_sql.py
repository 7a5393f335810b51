"""The quality rules in SQL, for checking."""

from timberline.llm.quality import HOST_RULES

RULES_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents
),
w AS (
  SELECT doc_id, host, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
),
win AS (
  SELECT doc_id, i, words[i:i + 4] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)
),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c >= 2
  ) GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id
),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         list_filter([
           CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 'dup_lines' END,
           CASE WHEN 2 * n_upper > word_chars THEN 'shouting' END,
           CASE WHEN 10 * n_symbols > n_words THEN 'symbols' END,
           CASE WHEN n_symbols > n_words THEN 'symbols_heavy' END,
           CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 'word_length' END
         ], lambda x: x IS NOT NULL) AS failed
  FROM m
),
hr AS (
  SELECT host, rule, count(*) AS n, CAST(sum(CASE WHEN list_contains(failed, rule) THEN 1 ELSE 0 END) AS BIGINT) AS bad
  FROM f, (SELECT unnest(['symbols', 'symbols_heavy', 'dup_lines', 'word_length', 'shouting']) AS rule) GROUP BY host, rule
),
s AS (
  SELECT rule, sum(n) AS total, count(*) AS hosts, (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS m FROM hr GROUP BY rule
),
pr AS (
  SELECT hr.rule, any_value(m) AS m,
         any_value(m) * (1 - any_value(m)) AS chance,
         greatest(sum(n * pow(bad::DOUBLE / n - m, 2)) / any_value(total)
                  - any_value(m) * (1 - any_value(m)) * any_value(hosts) / any_value(total), 1e-6::DOUBLE) AS between_hosts
  FROM hr JOIN s ON hr.rule = s.rule GROUP BY hr.rule
),
po AS (
  SELECT host, hr.rule, m AS overall, n + k AS both_, (bad + m * k) / (n + k) AS mean
  FROM hr JOIN (SELECT rule, m, least(greatest(chance / between_hosts - 1, 2.0::DOUBLE), 1000.0::DOUBLE) AS k FROM pr) p ON hr.rule = p.rule
),
lo AS (SELECT host, rule, overall, mean, mean - 2.0 * sqrt(mean * (1 - mean) / (both_ + 1)) AS lower FROM po),
v AS (
  SELECT host, list_sort(list(rule) FILTER (WHERE lower > 2.0 * overall)) AS host_failed, BOUNDS
  FROM lo GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR len(failed) >= 2 OR coalesce(list_has_any(failed, host_failed), false)) AS kept,
       array_to_string(failed, ',') AS failed_rules,
       coalesce(array_to_string(host_failed, ','), '') AS host_failed_rules, NAMES
FROM f LEFT JOIN v ON f.host IS NOT DISTINCT FROM v.host
""".replace("BOUNDS", ", ".join(f"max(round({w}, 6)) FILTER (WHERE rule = '{r}') AS {w}_{r}" for r in HOST_RULES for w in ("mean", "lower"))).replace(
    "NAMES", ", ".join(f"{w}_{r}" for r in HOST_RULES for w in ("mean", "lower"))
)
