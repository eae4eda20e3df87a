"""Model tables over the driver's tables, as SELECTs that Spark and DuckDB both read.

An order is a reaction of its customer's pathway: odd lines are its reactants, even lines its products, suppliers
its modifiers. Parts are compounds, suppliers proteins, nations states and regions canonical places.
"""

STANDINS = {
    "names": "SELECT p_partkey AS id, p_name, p_brand, p_type, p_size, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN concat(replace(p_name, ' ', '-'), ' + ', p_type) WHEN 3 THEN concat('  ', p_name, ' (', p_brand, ') ') ELSE concat(p_name, '  protein/', p_type) END AS name FROM part",
    "participants": "SELECT o_custkey AS pathway_id, o_orderkey AS process, l_linenumber AS pos, concat('c', l_partkey) AS entity, CASE WHEN l_linenumber % 2 = 1 THEN 'reactant' ELSE 'product' END AS role, concat('p', l_suppkey) AS modifier, l_quantity AS stoichiometry FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "processes": "SELECT o_custkey AS pathway_id, o_orderkey AS process, o_orderkey AS pos, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price, concat('s', o_custkey % 7) AS state FROM orders",
    "compounds": "SELECT p_partkey AS id, p_partkey AS pos, p_size AS pathway_id, p_name AS name, p_brand AS brand, p_type AS type, concat(p_brand, ' ', p_type) AS evidence FROM part",
    "proteins": "SELECT s_suppkey AS id, s_suppkey AS pos, s_nationkey AS pathway_id, s_name AS name, s_acctbal AS balance FROM supplier",
    "states": "SELECT n_nationkey AS id, n_name AS name, r_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey",
    "located": "SELECT c_custkey AS id, c_name AS entity, n_name AS state, r_name AS place, c_mktsegment AS kind, c_acctbal AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "papers": "SELECT doc_id, concat('Opening words\n', CASE doc_id % 4 WHEN 0 THEN 'Results\n' WHEN 1 THEN ' 2. Methods \n' WHEN 2 THEN 'REFERENCES\n' ELSE 'Materials and Methods\n' END, text, '\nAcknowledgments\nthanks') AS text FROM documents",
    "outputs": "SELECT conv_id, turn, role, text, length(text) AS size FROM conversations",
    "patches": "SELECT event_id AS seq, user_id AS pathway_id, CASE event_id % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'replace' ELSE 'remove' END AS op, CASE event_id % 4 WHEN 0 THEN concat('/element_locations/compound_locations/', event_id % 10) WHEN 1 THEN concat('/entities/compounds/', event_id % 10, '/name') WHEN 2 THEN concat('/processes/reactions/', event_id % 10) ELSE concat('/biological_states/', event_id % 10, '/name') END AS path, props AS value, value / 100 AS confidence, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS evidence, event_type AS source FROM events",
}
