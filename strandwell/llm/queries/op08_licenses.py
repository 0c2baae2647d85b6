"""op8: every document with the licence statements and notices that it holds."""

from pyspark.sql import DataFrame, SparkSession

from strandwell.llm.license_scan import SIZE, STATEMENTS, TEMPLATES, THRESHOLD, needed, plan, scan, template_words

NAME = "op8_license_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """The same windows, counted without MinHash; statements by the place of their words."""
    rows, shingles = [], []
    for group in plan():
        for number in group.numbers:
            words = template_words(TEMPLATES[number][1])
            distinct = {" ".join(words[k : k + SIZE]) for k in range(len(words) - SIZE + 1)}
            rows.append(f"({number}, '{TEMPLATES[number][0]}', {group.window}, {group.step}, {len(distinct)}, {needed(len(distinct), THRESHOLD)})")
            shingles += [f"({number}, '{s}')" for s in sorted(distinct)]
    said = [f"({len(TEMPLATES) + k}, '{license}', ' {' '.join(template_words(text))} ')" for k, (license, text) in enumerate(STATEMENTS)]
    return f"""
WITH t(template, license, width, step, size, need) AS (VALUES {", ".join(rows)}),
s(template, shingle) AS (VALUES {", ".join(shingles)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT r, doc_id, len(w) - 4 AS n, w, unnest(range(0, len(w) - 4)) AS k FROM d WHERE len(w) >= 5),
h AS (SELECT r, doc_id, n, k, array_to_string(w[k + 1 : k + 5], ' ') AS shingle FROM p),
m AS (SELECT r, doc_id, n, k, h.shingle, t.* FROM h JOIN s USING (shingle) JOIN t ON t.template = s.template),
v AS (SELECT *, unnest(range(greatest(0, (k - width + step) // step), k // step + 1)) * step AS start FROM m),
c AS (SELECT r, doc_id, template, license, size, need, start, count(DISTINCT shingle) AS held FROM v WHERE start <= k AND start > k - width GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY r, template ORDER BY held DESC, start) AS o FROM c WHERE held >= need)
SELECT doc_id, template, license, start::INTEGER AS first_word, held::INTEGER AS held, size AS template_shingles FROM b WHERE o = 1
UNION ALL
SELECT doc_id, template, license, (length(before) - length(replace(before, ' ', '')))::INTEGER, 1, 1
FROM (SELECT doc_id, a.template, a.license, substring(line, 1, strpos(line, words) - 1) AS before FROM (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d) l, (VALUES {", ".join(said)}) a(template, license, words) WHERE contains(line, words))
"""


ORACLE_SQL = _oracle()
