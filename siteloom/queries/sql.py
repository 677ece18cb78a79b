"""Pieces of SQL shared by the checks. They work on the raw HTML by regular expressions."""


def norm(u: str) -> str:
    query = f"regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"
    return (
        f"'https://' || lower(regexp_extract({u}, '^https?://([^/?#]*)', 1)) || "
        f"coalesce(nullif(rtrim(regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1), '/'), ''), '/') || "
        f"CASE WHEN {query} <> '' THEN '?' || array_to_string(list_sort(string_split({query}, '&')), '&') ELSE '' END"
    )


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^https?://([^/?#]*)', 1))"


def path(u: str) -> str:
    return f"rtrim(regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1), '/')"


def page_of(u: str) -> str:
    return f"regexp_replace(rtrim({u}, '/'), '[?#].*$', '')"


def title(s: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({s}, '[\\p{{L}}]+|[^\\p{{L}}]+'), "
        "lambda x: CASE x[1] WHEN 'ß' THEN 'Ss' ELSE upper(x[1]) END || lower(x[2:])), '')"
    )


def label(u: str) -> str:
    return title(f"translate(regexp_extract({path(u)}, '([^/]*)$', 1), '-_', '  ')")


def score(root: str, cand: str) -> str:
    return (
        f"CAST(CASE WHEN {host(root)} <> {host(cand)} THEN 0.0 "
        f"WHEN starts_with({path(cand)}, {path(root)} || '/') THEN 1.0 ELSE 0.3 END AS DOUBLE)"
    )


# every anchor of the pages table, in page order
LINKS = """
links AS (
  SELECT page_id, url, i - 1 AS pos, hrefs[i] AS href, labels[i] AS label,
         regexp_extract(url, '^(https?://[^/?#]*)', 1) || hrefs[i] AS link_url
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs,
               regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS labels FROM pages) t,
       unnest(range(1, len(hrefs) + 1)) AS u(i))
"""

# customers with their shop, nation and region, as the rendered sites show them
SHOPS = """
shops AS (
  SELECT 'shop' || (c_custkey // 500) AS plan_id, c_custkey // 500 AS site, r_regionkey, n_nationkey, c_custkey,
         r_name AS region, n_name AS nation, c_name AS name,
         CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment, CAST(c_acctbal AS VARCHAR) AS balance,
         'http://SHOP' || (c_custkey // 500) || '.example.com/n/' || n_nationkey AS url
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

SUPPLIERS = """
supplies AS (
  SELECT 'supply' || (s_suppkey // 200) AS plan_id, s_suppkey, s_acctbal, s_name AS name, s_acctbal < 2000 AS poor,
         CASE WHEN s_acctbal >= 2000 THEN CAST(s_acctbal AS VARCHAR) END AS balance,
         CASE WHEN s_acctbal >= 2000 THEN s_name END AS heading
  FROM supplier)
"""

# stored plans, one per customer
PLANS = """
plans AS (
  SELECT 'plan-' || c_custkey AS id, c_custkey, c_acctbal, n_name, n_regionkey, lower(c_mktsegment) AS kind,
         'http://Host' || c_nationkey || '.example.com/c/' || c_custkey || '/' AS root_url,
         c_acctbal >= 0 AS filled, c_acctbal < 3000 AS poor,
         CASE WHEN n_regionkey < 2 THEN lower(c_mktsegment) WHEN n_regionkey < 4 THEN 'Detail Page!' END AS kind2
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""
