"""Registered queries of the engine with the SQL that gives the same rows over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine

DB = "http://example.org/db/"
#: name -> (SPARQL, SQL)
QUERIES: dict[str, tuple[str, str]] = {
    # patterns and joins
    "bgp_star": (
        "SELECT ?k ?price ?status WHERE { ?o :o_orderkey ?k ; :o_totalprice ?price ; :o_orderstatus ?status . FILTER(?price > 400000.0) }",
        "SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_totalprice > 400000",
    ),
    "bgp_chain": (
        "SELECT ?c ?n ?r WHERE { ?cu :c_custkey ?c ; :c_nationkey ?na . ?na :n_name ?n ; :n_regionkey ?re . ?re :r_name ?r }",
        "SELECT c_custkey AS c, n_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "bgp_snowflake": (
        """SELECT ?r (COUNT(*) AS ?n) (ROUND(SUM(?p * (1.0e0 - ?d))) AS ?revenue) WHERE {
             ?l :l_extendedprice ?p ; :l_discount ?d ; :l_orderkey ?o ; :l_suppkey ?s . ?o :o_custkey ?c . ?c :c_nationkey ?n1 . ?s :s_nationkey ?n1 . ?n1 :n_regionkey/:r_name ?r } GROUP BY ?r""",
        """SELECT r_name AS r, count(*) AS n, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
           JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    ),
    "filter_range": (
        "SELECT (COUNT(*) AS ?n) WHERE { ?l :l_quantity ?q ; :l_shipdate ?d ; :l_discount ?x . FILTER(?q < 24 && ?d >= \"1995-01-01T00:00:00\"^^xsd:dateTime && ?d < \"1996-01-01T00:00:00\"^^xsd:dateTime && ?x >= 0.05 && ?x <= 0.07) }",
        "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 24 AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_discount >= 0.05 AND l_discount <= 0.07",
    ),
    "filter_logic3vl": (
        "SELECT ?k WHERE { ?p :p_partkey ?k ; :p_size ?s ; :p_retailprice ?r . FILTER((?s / 0 > 1) || ?s > 40) FILTER(!(?r < 950.0 && ?s < 45)) }",
        "SELECT p_partkey AS k FROM part WHERE p_size > 40 AND NOT (p_retailprice < 950 AND p_size < 45)",
    ),
    "filter_in": (
        'SELECT ?k WHERE { ?o :o_orderkey ?k ; :o_orderstatus ?s ; :o_orderpriority ?p . FILTER(?s IN ("F", "P")) FILTER(?k IN (1, 2, 3, 5, 7, 11, 13, 17)) }',
        "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey IN (1, 2, 3, 5, 7, 11, 13, 17)",
    ),
    "filter_not_in": (
        'SELECT ?t (COUNT(*) AS ?n) WHERE { ?e :event_type ?t . FILTER(?t NOT IN ("view", "click")) } GROUP BY ?t',
        "SELECT event_type AS t, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1",
    ),
    "pattern_var_predicate": (
        "SELECT ?s ?p ?o WHERE { ?s a :nation ; ?p ?o }",
        f"""WITH n AS (SELECT '{DB}nation/' || n_nationkey AS s, * FROM nation)
            SELECT s, '{DB}n_name' AS p, n_name AS o FROM n UNION ALL SELECT s, '{DB}n_nationkey', CAST(n_nationkey AS VARCHAR) FROM n
            UNION ALL SELECT s, '{DB}n_regionkey', '{DB}region/' || n_regionkey FROM n UNION ALL SELECT s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{DB}nation' FROM n""",
    ),
    "repeated_variable": (
        "SELECT ?k WHERE { ?p :p_size ?k ; :p_partkey ?k }",
        "SELECT p_partkey AS k FROM part WHERE p_size = p_partkey",
    ),
    "optional_basic": (
        'SELECT ?c ?o WHERE { ?cu :c_custkey ?c ; :c_mktsegment "BUILDING" OPTIONAL { ?or :o_custkey ?cu ; :o_orderkey ?o } }',
        "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    ),
    "optional_condition": (
        "SELECT ?c ?o WHERE { ?cu :c_custkey ?c ; :c_acctbal ?b OPTIONAL { ?or :o_custkey ?cu ; :o_orderkey ?o ; :o_totalprice ?p FILTER(?p > 450000.0 && ?b > 0.0) } }",
        "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000 AND c_acctbal > 0",
    ),
    "optional_nested": (
        """SELECT ?n ?s ?o WHERE { ?na :n_name ?n OPTIONAL { ?su :s_nationkey ?na ; :s_suppkey ?s
             OPTIONAL { ?l :l_suppkey ?su ; :l_orderkey/:o_orderkey ?o ; :l_quantity ?q FILTER(?q > 49.5) } } }""",
        """SELECT n_name AS n, s_suppkey AS s, o AS o FROM nation LEFT JOIN (SELECT * FROM supplier LEFT JOIN (SELECT l_suppkey, o_orderkey AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 49.5)
           ON l_suppkey = s_suppkey) ON s_nationkey = n_nationkey""",
    ),
    "union_basic": (
        "SELECT ?name ?b WHERE { { ?c :c_name ?name ; :c_acctbal ?b } UNION { ?s :s_name ?name ; :s_acctbal ?b } FILTER(?b > 9000.0) }",
        "SELECT c_name AS name, c_acctbal AS b FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal > 9000",
    ),
    "union_unbound": (
        "SELECT ?c ?s WHERE { { ?x :c_custkey ?c } UNION { ?y :s_suppkey ?s } }",
        "SELECT c_custkey AS c, NULL::BIGINT AS s FROM customer UNION ALL SELECT NULL, s_suppkey FROM supplier",
    ),
    "cross_product": ("SELECT ?a ?b WHERE { ?x :r_name ?a . ?y :n_name ?b }", "SELECT r_name AS a, n_name AS b FROM region, nation"),
    "theta_self_join": (
        "SELECT ?a ?b WHERE { ?x :s_suppkey ?a ; :s_nationkey ?n . ?y :s_suppkey ?b ; :s_nationkey ?n FILTER(?a < ?b) }",
        "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey",
    ),
    "exists_semi": (
        "SELECT ?c WHERE { ?cu :c_custkey ?c FILTER EXISTS { ?o :o_custkey ?cu ; :o_totalprice ?p FILTER(?p > 480000.0) } }",
        "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)",
    ),
    "not_exists_anti": (
        "SELECT ?c WHERE { ?cu :c_custkey ?c FILTER NOT EXISTS { ?o :o_custkey ?cu ; :o_totalprice ?p FILTER(?p > 300000.0) } }",
        "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    ),
    "not_exists_outer_variable": (
        "SELECT ?c WHERE { ?cu :c_custkey ?c ; :c_acctbal ?b FILTER NOT EXISTS { ?o :o_custkey ?cu ; :o_totalprice ?p FILTER(?p > ?b * 60) } }",
        "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 60)",
    ),
    "exists_in_or": (
        "SELECT ?c WHERE { ?cu :c_custkey ?c ; :c_acctbal ?b FILTER(?b > 9500.0 || EXISTS { ?o :o_custkey ?cu ; :o_totalprice ?p FILTER(?p > 490000.0) }) }",
        "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9500 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)",
    ),
    "minus_shared": (
        'SELECT ?k WHERE { ?p :p_partkey ?k MINUS { ?p :p_size ?s FILTER(?s > 10) } }',
        "SELECT p_partkey AS k FROM part WHERE NOT p_size > 10",
    ),
    "minus_disjoint": ("SELECT ?n WHERE { ?x :n_name ?n MINUS { ?y :r_name ?r } }", "SELECT n_name AS n FROM nation"),
    "values_join": (
        'SELECT ?n ?k WHERE { VALUES (?r ?k) { ("AFRICA" 1) ("ASIA" 2) ("EUROPE" 3) } ?re :r_name ?r . ?x :n_regionkey ?re ; :n_name ?n }',
        "SELECT n_name AS n, k FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES ('AFRICA', 1::BIGINT), ('ASIA', 2), ('EUROPE', 3)) v(r, k) ON r = r_name",
    ),
    "values_undef": (
        'SELECT ?n ?r WHERE { ?x :n_name ?n ; :n_regionkey/:r_name ?r VALUES (?n ?r) { ("NATION_1" UNDEF) (UNDEF "ASIA") } }',
        "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES ('NATION_1', NULL), (NULL, 'ASIA')) v(a, b) ON (a IS NULL OR a = n_name) AND (b IS NULL OR b = r_name)",
    ),
    "bind_expr": (
        "SELECT ?k ?net WHERE { ?o :o_orderkey ?k ; :o_totalprice ?p BIND(?p * 0.5e0 AS ?net) FILTER(?net > 240000.0) }",
        "SELECT o_orderkey AS k, o_totalprice * 0.5 AS net FROM orders WHERE o_totalprice * 0.5 > 240000",
    ),
    "project_expr": (
        "SELECT ?k (?s + 1 AS ?next) (?r - ?s AS ?diff) WHERE { ?p :p_partkey ?k ; :p_size ?s ; :p_retailprice ?r }",
        "SELECT p_partkey AS k, CAST(p_size + 1 AS BIGINT) AS next, p_retailprice - p_size AS diff FROM part",
    ),
    "if_coalesce": (
        'SELECT ?k (IF(?s > 25, "big", "small") AS ?size) (COALESCE(?s / 0, ?s) AS ?safe) WHERE { ?p :p_partkey ?k ; :p_size ?s }'.replace("COALESCE(?s / 0, ?s)", "COALESCE(xsd:integer(STR(?nothing)), ?s)"),
        "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size, CAST(p_size AS BIGINT) AS safe FROM part",
    ),
    # aggregation and modifiers
    "group_sum": (
        "SELECT ?f ?s (SUM(?q) AS ?sum_qty) (COUNT(*) AS ?n) (ROUND(SUM(?p)) AS ?sum_price) WHERE { ?l :l_returnflag ?f ; :l_linestatus ?s ; :l_quantity ?q ; :l_extendedprice ?p } GROUP BY ?f ?s",
        "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS sum_qty, count(*) AS n, floor(sum(l_extendedprice) + 0.5) AS sum_price FROM lineitem GROUP BY 1, 2",
    ),
    "group_count_distinct": (
        "SELECT ?t (COUNT(DISTINCT ?u) AS ?users) (COUNT(?u) AS ?n) WHERE { ?e :event_type ?t ; :user_id ?u } GROUP BY ?t",
        "SELECT event_type AS t, count(DISTINCT user_id) AS users, count(user_id) AS n FROM events GROUP BY 1",
    ),
    "group_having": (
        "SELECT ?u (COUNT(*) AS ?n) WHERE { ?e :user_id ?u } GROUP BY ?u HAVING(COUNT(*) > 70)",
        "SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 70",
    ),
    "group_concat": (
        'SELECT ?r (GROUP_CONCAT(?n; SEPARATOR="|") AS ?names) WHERE { ?x :n_name ?n ; :n_regionkey/:r_name ?r } GROUP BY ?r',
        "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "group_min_max": (
        "SELECT ?b (MIN(?p) AS ?low) (MAX(?p) AS ?high) (MAX(?n) AS ?last) WHERE { ?x :p_brand ?b ; :p_retailprice ?p ; :p_name ?n } GROUP BY ?b",
        "SELECT p_brand AS b, min(p_retailprice) AS low, max(p_retailprice) AS high, max(p_name) AS last FROM part GROUP BY 1",
    ),
    "group_expr_key": (
        "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)",
        "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1",
    ),
    "group_avg": (
        "SELECT ?t (ROUND(AVG(?v) * 1000) AS ?mean) (xsd:double(AVG(?u)) AS ?users) WHERE { ?e :event_type ?t ; :value ?v ; :user_id ?u } GROUP BY ?t",
        "SELECT event_type AS t, floor(avg(value) * 1000 + 0.5) AS mean, avg(user_id) AS users FROM events GROUP BY 1",
    ),
    "group_sample": ("SELECT ?r (SAMPLE(?n) AS ?name) WHERE { ?x :r_regionkey ?r ; :r_name ?n } GROUP BY ?r", "SELECT CAST(r_regionkey AS BIGINT) AS r, r_name AS name FROM region"),
    "group_sum_distinct": (
        "SELECT ?b (SUM(DISTINCT ?s) AS ?total) (COUNT(DISTINCT *) AS ?rows) WHERE { ?x :p_brand ?b ; :p_size ?s } GROUP BY ?b",
        "SELECT p_brand AS b, CAST(sum(DISTINCT p_size) AS BIGINT) AS total, count(*) AS rows FROM part GROUP BY 1",
    ),
    "agg_empty": (
        'SELECT (COUNT(?x) AS ?n) (SUM(?p) AS ?total) (MAX(?p) AS ?top) WHERE { ?x :o_totalprice ?p FILTER(?p < 0.0) }',
        "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS total, NULL::DOUBLE AS top",
    ),
    "agg_over_expr": (
        "SELECT ?s (ROUND(SUM(?p * (1.0e0 - ?d) * (1.0e0 + ?t)) / COUNT(*)) AS ?mean_charge) WHERE { ?l :l_linestatus ?s ; :l_extendedprice ?p ; :l_discount ?d ; :l_tax ?t } GROUP BY ?s",
        "SELECT l_linestatus AS s, floor(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) / count(*) + 0.5) AS mean_charge FROM lineitem GROUP BY 1",
    ),
    "subquery_agg": (
        "SELECT ?n ?orders WHERE { ?c :c_name ?n { SELECT ?c (COUNT(*) AS ?orders) WHERE { ?o :o_custkey ?c } GROUP BY ?c } FILTER(?orders > 17) }",
        "SELECT c_name AS n, orders FROM customer JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE orders > 17",
    ),
    "subquery_topk": (
        "SELECT ?k ?n WHERE { { SELECT ?c ?k WHERE { ?o :o_custkey ?c ; :o_orderkey ?k } ORDER BY DESC(?k) LIMIT 20 } ?c :c_name ?n }",
        "SELECT k, c_name AS n FROM (SELECT o_custkey, o_orderkey AS k FROM orders ORDER BY k DESC LIMIT 20) JOIN customer ON o_custkey = c_custkey",
    ),
    "order_topk": (
        "SELECT ?k ?p WHERE { ?o :o_orderkey ?k ; :o_totalprice ?p } ORDER BY DESC(?p) ?k LIMIT 25",
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 25",
    ),
    "slice_offset": (
        "SELECT ?k WHERE { ?o :o_orderkey ?k } ORDER BY ?k OFFSET 100 LIMIT 50",
        "SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 50 OFFSET 100",
    ),
    "distinct_select": ("SELECT DISTINCT ?b ?t WHERE { ?p :p_brand ?b ; :p_type ?t }", "SELECT DISTINCT p_brand AS b, p_type AS t FROM part"),
    "reduced_select": ("SELECT REDUCED ?s WHERE { ?c :c_mktsegment ?s }", "SELECT DISTINCT c_mktsegment AS s FROM customer"),
    # functions
    "str_functions": (
        'SELECT ?k (STRLEN(?n) AS ?len) (SUBSTR(?n, 2, 4) AS ?sub) (UCASE(?n) AS ?up) (LCASE(?n) AS ?low) (CONCAT(?n, "-", ?b) AS ?both) (STRBEFORE(?b, "#") AS ?pre) (STRAFTER(?b, "#") AS ?post) WHERE { ?p :p_partkey ?k ; :p_name ?n ; :p_brand ?b FILTER(STRSTARTS(?b, "B") && CONTAINS(?n, "a")) }',
        """SELECT p_partkey AS k, length(p_name) AS len, substr(p_name, 2, 4) AS sub, upper(p_name) AS up, lower(p_name) AS low, p_name || '-' || p_brand AS "both",
           CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 1) ELSE '' END AS pre, CASE WHEN contains(p_brand, '#') THEN substr(p_brand, instr(p_brand, '#') + 1) ELSE '' END AS post
           FROM part WHERE starts_with(p_brand, 'B') AND contains(p_name, 'a')""",
    ),
    "regex_filter": ('SELECT ?k WHERE { ?c :c_custkey ?k ; :c_name ?n FILTER REGEX(?n, "0[13579]$", "i") }', "SELECT c_custkey AS k FROM customer WHERE regexp_matches(c_name, '0[13579]$')"),
    "replace_fn": ('SELECT ?k (REPLACE(?n, "([0-9]+)", "<$1>") AS ?r) WHERE { ?x :n_nationkey ?k ; :n_name ?n }', r"SELECT CAST(n_nationkey AS BIGINT) AS k, regexp_replace(n_name, '([0-9]+)', '<\1>', 'g') AS r FROM nation"),
    "hash_fn": (
        "SELECT ?k (MD5(?n) AS ?m) (SHA1(?n) AS ?s1) (SHA256(?n) AS ?s256) WHERE { ?p :p_partkey ?k ; :p_name ?n }",
        "SELECT p_partkey AS k, md5(p_name) AS m, sha1(p_name) AS s1, sha256(p_name) AS s256 FROM part",
    ),
    "encode_uri": ("SELECT ?k (ENCODE_FOR_URI(?u) AS ?e) WHERE { ?p :page_id ?k ; :url ?u }", "SELECT page_id AS k, url_encode(url) AS e FROM pages"),
    "date_parts": (
        "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?mi) WHERE { ?e :event_id ?k ; :ts ?d }",
        "SELECT event_id AS k, year(ts) AS y, month(ts) AS m, day(ts) AS dd, hour(ts) AS h, minute(ts) AS mi FROM events",
    ),
    "num_functions": (
        "SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) WHERE { ?x :c_custkey ?k ; :c_acctbal ?b }",
        "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, floor(c_acctbal + 0.5) AS r FROM customer",
    ),
    "cast_fn": (
        'SELECT ?k (xsd:integer(?q) AS ?i) (xsd:string(?k) AS ?s) (xsd:double(?k) AS ?d) (xsd:boolean(?k) AS ?b) WHERE { ?p :p_partkey ?k ; :p_retailprice ?r BIND(FLOOR(?r) AS ?q) }',
        "SELECT p_partkey AS k, CAST(floor(p_retailprice) AS BIGINT) AS i, CAST(p_partkey AS VARCHAR) AS s, CAST(p_partkey AS DOUBLE) AS d, p_partkey <> 0 AS b FROM part",
    ),
    "term_tests": (
        "SELECT ?k (ISIRI(?c) AS ?iri) (ISLITERAL(?k) AS ?lit) (ISNUMERIC(?k) AS ?num) (ISBLANK(?c) AS ?bn) (STR(DATATYPE(?k)) AS ?dt) WHERE { ?o :o_orderkey ?k ; :o_custkey ?c }",
        "SELECT o_orderkey AS k, true AS iri, true AS lit, true AS num, false AS bn, 'http://www.w3.org/2001/XMLSchema#integer' AS dt FROM orders",
    ),
    "iri_of_row": ("SELECT ?c (STR(?c) AS ?s) WHERE { ?c :c_custkey ?k FILTER(?c != :nothing) }", f"SELECT '{DB}customer/' || c_custkey AS c, '{DB}customer/' || c_custkey AS s FROM customer"),
    "lang_filter": (
        'SELECT ?k (LANG(?t) AS ?l) (STRLEN(?t) AS ?n) WHERE { ?d :doc_id ?k ; :text ?t FILTER(LANGMATCHES(LANG(?t), "fr") || LANG(?t) = "de") }',
        "SELECT doc_id AS k, lang AS l, length(text) AS n FROM documents WHERE lang IN ('fr', 'de')",
    ),
    "fn_log": ("SELECT ?k (ROUND(fn:log(?r) * 1000000) AS ?l) WHERE { ?p :p_partkey ?k ; :p_retailprice ?r }", "SELECT p_partkey AS k, floor(log10(p_retailprice) * 1000000 + 0.5) AS l FROM part"),
    "fn_parse_date": ('SELECT ?k (fn:parse_date(?d, "yyyy/MM/dd") AS ?s) WHERE { ?o :o_orderkey ?k ; :o_orderdate ?d }', "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y/%m/%d') AS s FROM orders"),
    "tf_split": ('SELECT ?k ?w WHERE { ?p :p_partkey ?k ; :p_name ?n BIND(fn:split(?n, "[ #]") AS ?w) }', "SELECT p_partkey AS k, unnest(regexp_split_to_array(p_name, '[ #]')) AS w FROM part"),
    "fulltext_match": (
        'SELECT ?k WHERE { ?d :doc_id ?k ; search:matches [ search:query "license +mit" ; search:property :text ] }',
        "SELECT doc_id AS k FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'mit')",
    ),
    # paths
    "path_sequence": ("SELECT ?k ?r WHERE { ?c :c_custkey ?k ; :c_nationkey/:n_regionkey/:r_name ?r }", "SELECT c_custkey AS k, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_alternative": (
        "SELECT ?k ?n WHERE { ?x :n_nationkey ?k . ?y (:c_nationkey|:s_nationkey) ?x ; (:c_name|:s_name) ?n }",
        "SELECT CAST(n_nationkey AS BIGINT) AS k, c_name AS n FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT CAST(n_nationkey AS BIGINT), s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey",
    ),
    "path_inverse": ('SELECT ?n WHERE { ?r :r_name "ASIA" ; ^:n_regionkey/:n_name ?n }', "SELECT n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "path_zero_or_one": (
        "SELECT ?a ?b WHERE { ?x :turn 0 ; :conv_id ?a . ?x :next? ?y . ?y :turn ?b }",
        "SELECT conv_id AS a, b FROM (SELECT conv_id, unnest([0::BIGINT, nxt]) AS b FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE turn = 0) WHERE b IS NOT NULL",
    ),
    "path_plus": (
        "SELECT ?c ?a ?b WHERE { ?x :next+ ?y . ?x :turn ?a ; :conv_id ?c . ?y :turn ?b }",
        "SELECT x.conv_id AS c, x.turn AS a, y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn < y.turn",
    ),
    "path_star": (
        "SELECT ?c ?a ?b WHERE { ?x :turn ?a ; :conv_id ?c . ?x :next* ?y . ?y :turn ?b }",
        "SELECT x.conv_id AS c, x.turn AS a, y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn <= y.turn",
    ),
    "path_bounded": (
        "SELECT ?c ?a ?b WHERE { ?x :next{2,3} ?y . ?x :turn ?a ; :conv_id ?c . ?y :turn ?b }",
        "WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT x.conv_id AS c, x.turn AS a, y.turn AS b FROM t x JOIN t y ON x.conv_id = y.conv_id AND y.r - x.r IN (2, 3)",
    ),
    "path_negated": (
        "SELECT ?s ?o WHERE { ?s a :region . ?s !(:r_name|rdf:type) ?o }",
        f"SELECT '{DB}region/' || r_regionkey AS s, CAST(r_regionkey AS VARCHAR) AS o FROM region",
    ),
    "path_from_constant": (
        "SELECT ?b WHERE { <http://example.org/db/conversations/300000> :next* ?y . ?y :turn ?b }",
        "SELECT turn AS b FROM conversations WHERE conv_id = 3",
    ),
    # graphs
    "graph_named": ("SELECT ?s ?n WHERE { GRAPH :nation { ?s :n_name ?n } }", f"SELECT '{DB}nation/' || n_nationkey AS s, n_name AS n FROM nation"),
    "graph_variable": ("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s :n_regionkey ?o } } GROUP BY ?g", f"SELECT '{DB}nation' AS g, count(*) AS n FROM nation"),
    "from_dataset": ("SELECT ?n FROM :nation FROM :region WHERE { ?s :n_name ?n . ?s :n_regionkey ?r . ?r :r_name ?x }", "SELECT n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "flagship_revenue": (
        """SELECT ?nation (ROUND(SUM(?price * (1.0e0 - ?disc))) AS ?revenue) (COUNT(DISTINCT ?o) AS ?orders) WHERE {
             ?l :l_orderkey ?o ; :l_extendedprice ?price ; :l_discount ?disc . ?o :o_custkey/:c_nationkey/:n_name ?nation } GROUP BY ?nation""",
        """SELECT n_name AS nation, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    ),
}


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine.over_tables(spark, sf_dir).select(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_extra, catalog_more

    return {name: _run(text) for name, (text, _) in QUERIES.items()} | catalog_more.queries() | catalog_extra.queries()


def oracle_sql() -> dict[str, str]:
    from . import catalog_extra, catalog_more

    return {name: sql for name, (_, sql) in QUERIES.items()} | catalog_more.oracle_sql() | catalog_extra.oracle_sql()
