"""op9: the licences of every document."""

from .license_scan import RULES, SENTENCES, license_scan

NAME = "op9_license_scan"


def query(spark, sf_dir):
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    known = ", ".join(f"('{t}', '{i}')" for i, t in SENTENCES.items())
    fits = ", ".join("CASE WHEN regexp_matches(p, '{}') THEN '{}' END".format(" " + " (.* )?".join(x.replace(".", "\\.") for x in rule) + " ", name) for name, rule in RULES)
    return f"""
WITH known(t, id) AS (VALUES {known}),
parts AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[.!?;]+(\\s|$)', chr(10), 'g'), '[\\r\\n]+'), lambda s: trim(s) <> '') AS ps FROM documents),
said AS (SELECT doc_id, i, trim(regexp_replace(lower(ps[i]), '[^a-z0-9]+', ' ', 'g')) AS t FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM parts)),
ids AS (SELECT doc_id, string_agg(id, ' ' ORDER BY i) AS s FROM said JOIN known USING (t) GROUP BY doc_id),
rows AS (SELECT doc_id, len(ps) AS n, coalesce(s, '') AS s, ' ' || coalesce(s, '') || ' ' AS p FROM parts LEFT JOIN ids USING (doc_id)),
fit AS (SELECT doc_id, n, s, list_filter([{fits}], lambda x: x IS NOT NULL) AS f FROM rows),
one AS (SELECT doc_id, n, s, list_filter(f, lambda x, i: list_position(f, x) = i) AS f FROM fit)
SELECT doc_id, s AS sentence_ids, CAST(n AS BIGINT) AS n_sentences, array_to_string(f, '|') AS licenses, CAST(len(f) AS BIGINT) AS n_licenses FROM one
"""


SQL = _sql()
