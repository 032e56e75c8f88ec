"""DuckDB SQL of the shared tables: one list of common table expressions ahead of every counterpart query."""

from __future__ import annotations

# Segments, classes, census variables, index numbers, terms and labels of the study, as in the Spark code
FIXTURES = """
ord AS (
  SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) + 21 AS INTEGER) AS yr,
         CAST(CAST(o_orderdate AS DATE) + INTERVAL 21 YEAR AS DATE) AS sold
  FROM orders),
seg AS (
  SELECT * FROM (VALUES ('BUILDING', '202', 'B03002_012'), ('HOUSEHOLD', '203', 'B03002_003'),
    ('FURNITURE', '212', 'B03002_004'), ('AUTOMOBILE', '299', 'B03002_006'), ('MACHINERY', '218', 'B03002_008'))
    AS t(segment, class, variable)),
cust AS (
  SELECT c_custkey, c_nationkey, s.class, s.variable FROM customer JOIN seg s ON c_mktsegment = s.segment),
sales AS (
  SELECT CAST(o_custkey AS VARCHAR) || '0000' AS pin, yr AS year, strftime(sold, '%B %d %Y') AS sale_date,
         o_totalprice AS sale_price, o_orderkey AS sale_key
  FROM ord),
li AS (
  SELECT l_orderkey, l_suppkey, l_linenumber, l_returnflag, o_custkey, yr,
         l_extendedprice AS m, l_extendedprice * (1 - l_discount / 2) AS c, l_extendedprice * (1 - l_discount) AS b,
         l_extendedprice * l_tax AS t
  FROM lineitem JOIN ord ON l_orderkey = o_orderkey),
assessments AS (
  SELECT yr AS year, CAST(o_custkey AS VARCHAR) || '0000' AS pin,
         CAST(any_value(c_nationkey) + 10 AS VARCHAR) || '001' AS tax_code_num, any_value(class) AS class,
         sum(t) AS tax_bill_total, 0.1::DOUBLE * sum(m) AS av_mailed, 0.1::DOUBLE * sum(c) AS av_certified,
         0.1::DOUBLE * sum(b) AS av_board, 0.1::DOUBLE * sum(b) AS av_clerk
  FROM li JOIN cust ON o_custkey = c_custkey GROUP BY o_custkey, yr
  UNION ALL
  SELECT yr, '9' || lpad(CAST(l_suppkey AS VARCHAR), 13, '0'), CAST(any_value(s_nationkey) + 10 AS VARCHAR) || '001',
         '517', sum(t), 0.1::DOUBLE * sum(m), 0.1::DOUBLE * sum(c), 0.1::DOUBLE * sum(b), 0.1::DOUBLE * sum(b)
  FROM li JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey, yr),
class_dict AS (
  SELECT * FROM (VALUES ('202', 'Single-Family', 'Residential', true), ('203', 'Single-Family', 'Residential', true),
    ('212', 'Multi-Family', 'Residential', true), ('299', 'Condominium', 'Residential', true),
    ('218', 'Bed & Breakfast', 'Residential', true), ('517', 'Commercial', 'Commercial', false))
    AS t(class_code, reporting_group, major_class_type, regression_class)),
townships AS (
  SELECT CAST(n_nationkey + 10 AS VARCHAR) AS township_code,
         CASE r_name WHEN 'AMERICA' THEN 'City' WHEN 'EUROPE' THEN 'North' ELSE 'South' END AS triad_name
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AMERICA', 'EUROPE', 'ASIA')),
appeals AS (
  SELECT yr AS tax_year,
         CASE l_linenumber WHEN 2 THEN 0.0 WHEN 1 THEN 100 * CAST(class AS DOUBLE) ELSE CAST(class AS DOUBLE) END AS class,
         c_nationkey + 10 AS township_code,
         CASE l_returnflag WHEN 'A' THEN 'No Change' WHEN 'R' THEN 'Decrease' WHEN 'N' THEN 'Increase' END AS result,
         0.1::DOUBLE * m AS assessor_totalvalue, 0.1::DOUBLE * b AS bor_totalvalue
  FROM li JOIN cust ON o_custkey = c_custkey),
prices AS (
  SELECT CAST(y AS INTEGER) AS year, CAST(cs AS DOUBLE) AS case_shiller, CAST(h AS DOUBLE) AS hpi FROM (VALUES
    (2006, 1.663090915, 1.14407178), (2007, 1.695792557, 1.174738966), (2008, 1.859953584, 1.376691816),
    (2009, 2.054125555, 1.66707653), (2010, 2.109306578, 1.797687182), (2011, 2.191465155, 1.96643901),
    (2012, 2.164322318, 2.015771149), (2013, 1.974783404, 1.87304141), (2014, 1.852951133, 1.755724941),
    (2015, 1.772351191, 1.674818614), (2016, 1.686676152, 1.572943284), (2017, 1.594359191, 1.47916753),
    (2018, 1.507122687, 1.403425097), (2019, 1.456873311, 1.354186158), (2020, 1.373748227, 1.266441223),
    (2021, 1.173319935, 1.142716924), (2022, 1.022240399, 1.027848684), (2023, 1.0, 1.0)) AS t(y, cs, h)),
calendar AS (
  SELECT CAST(y AS INTEGER) AS year,
         CASE (y - 2011) % 3 WHEN 0 THEN 'South' WHEN 1 THEN 'City' ELSE 'North' END AS triad_name
  FROM range(2011, 2023) AS r(y)),
acs_counts AS (
  SELECT nation, variable, CAST(count(*) AS DOUBLE) AS estimate FROM (
    SELECT c_nationkey AS nation, variable FROM cust
    UNION ALL SELECT s_nationkey, 'B03002_007' FROM supplier) GROUP BY nation, variable),
acs_race AS (
  SELECT CAST(nation + 100 AS VARCHAR) AS geoid, variable, estimate,
         sum(estimate) OVER (PARTITION BY nation) AS summary_est
  FROM acs_counts),
vec AS (
  SELECT vec_id, lpad(CAST(vec_id AS VARCHAR), 10, '0') AS pin10, CAST(embedding[1] AS DOUBLE) AS longitude,
         CAST(embedding[2] AS DOUBLE) AS latitude
  FROM embeddings),
pin_points AS (
  SELECT pin10, longitude, latitude FROM vec
  UNION ALL SELECT pin10, longitude + 0.01::DOUBLE, latitude FROM vec WHERE vec_id % 7 = 0),
squares AS (
  SELECT i, -0.45::DOUBLE + 0.18::DOUBLE * (i % 5) AS x0, -0.45::DOUBLE + 0.18::DOUBLE * (i % 5 + 1) AS x1,
         -0.45::DOUBLE + 0.18::DOUBLE * (i // 5) AS y0, -0.45::DOUBLE + 0.18::DOUBLE * (i // 5 + 1) AS y1
  FROM range(25) AS r(i)),
block_groups AS (
  SELECT CAST(i + 100 AS VARCHAR) AS geoid, CAST(i + 1100 AS DOUBLE) AS estimate, x0, x1, y0, y1,
         CASE WHEN i = 12 THEN
           [[x0, y0], [x1, y0], [x1, (y0 + y1) / 2], [(x0 + x1) / 2, (y0 + y1) / 2], [(x0 + x1) / 2, y1], [x0, y1], [x0, y0]]
         ELSE [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]] END AS ring
  FROM squares),
edges AS (
  SELECT geoid, ring[k][1] AS ax, ring[k][2] AS ay, ring[k + 1][1] AS bx, ring[k + 1][2] AS by_
  FROM (SELECT geoid, ring, unnest(range(1, len(ring))) AS k FROM block_groups)),
tile_at AS (
  SELECT CAST(floor(longitude / 0.02::DOUBLE) AS BIGINT) AS cx, CAST(floor(latitude / 0.02::DOUBLE) AS BIGINT) AS cy, label
  FROM vec JOIN embeddings USING (vec_id)),
tile_votes AS (SELECT cx, cy, label, count(*) AS n FROM tile_at GROUP BY ALL),
tiles AS (
  SELECT lpad(CAST(cx + 50000 AS VARCHAR), 6, '0') || lpad(CAST(cy + 50000 AS VARCHAR), 6, '0') AS geoid, cx, cy,
         CAST(label % 3 AS VARCHAR) AS category, CAST(total AS BIGINT) AS n
  FROM (SELECT *, sum(n) OVER (PARTITION BY cx, cy) AS total,
               row_number() OVER (PARTITION BY cx, cy ORDER BY n DESC, label) AS rn FROM tile_votes)
  WHERE rn = 1)
"""

ROLLS = """
roll AS (
  SELECT a.*, d.reporting_group, d.major_class_type, d.regression_class, substr(a.tax_code_num, 1, 2) AS township_code,
         t.triad_name
  FROM assessments a JOIN class_dict d ON a.class = d.class_code
  LEFT JOIN townships t ON t.township_code = substr(a.tax_code_num, 1, 2)
  WHERE a.year BETWEEN 2006 AND 2022),
class_year AS (
  SELECT year, major_class_type, count(*) AS pin_total_count, sum(av_board) AS av_board FROM roll GROUP BY ALL),
class_year_triad AS (
  SELECT year, major_class_type, triad_name, count(*) AS pin_total_count, sum(av_board) AS av_board
  FROM roll GROUP BY ALL),
appeal_base AS (
  SELECT a.tax_year, a.class, a.township_code, a.result, a.assessor_totalvalue AS assessor_total,
         a.bor_totalvalue AS bor_total, d.class_code AS class_char, d.reporting_group, d.major_class_type,
         d.regression_class, CASE WHEN d.major_class_type = 'Residential' THEN 'Residential' ELSE 'Non-residential' END AS res_nonres_label
  FROM appeals a JOIN class_dict d
    ON CAST(CAST(CASE WHEN a.class >= 1000 THEN a.class / 100 ELSE a.class END AS BIGINT) AS VARCHAR) = d.class_code
  WHERE a.tax_year >= 2006 AND a.class <> 0),
appeal_sums AS (
  SELECT tax_year, major_class_type, result, count(*) AS "count", sum(assessor_total) AS assessor_total,
         sum(bor_total) AS bor_total
  FROM appeal_base GROUP BY ALL),
appeal_sums_triad AS (
  SELECT tax_year, major_class_type, result, triad_name, count(*) AS "count", sum(assessor_total) AS assessor_total,
         sum(bor_total) AS bor_total
  FROM appeal_base a LEFT JOIN townships t ON CAST(a.township_code AS VARCHAR) = t.township_code
  GROUP BY tax_year, major_class_type, result, triad_name),
rates AS (
  SELECT p.year, p.major_class_type, p.pin_total_count, p.av_board, s.result, s."count", s.assessor_total, s.bor_total,
         s."count" / p.pin_total_count AS ratio
  FROM class_year p LEFT JOIN appeal_sums s ON p.year = s.tax_year AND p.major_class_type = s.major_class_type),
rates_triad AS (
  SELECT p.year, p.major_class_type, p.triad_name, p.pin_total_count, p.av_board, s.result, s."count",
         s.assessor_total, s.bor_total, s."count" / p.pin_total_count AS ratio
  FROM class_year_triad p LEFT JOIN appeal_sums_triad s
    ON p.year = s.tax_year AND p.major_class_type = s.major_class_type AND p.triad_name IS NOT DISTINCT FROM s.triad_name),
tax_base AS (
  SELECT major_class_type, year, sum(av_mailed) AS av_mailed, sum(av_board) AS av_board,
         sum(av_certified) AS av_certified, sum(av_clerk) AS av_clerk, sum(tax_bill_total) AS tax_bill_total
  FROM roll WHERE year >= 2011 GROUP BY ALL),
tax_share AS (
  SELECT major_class_type, year, av_mailed / sum(av_mailed) OVER w AS av_mailed,
         av_board / sum(av_board) OVER w AS av_board, tax_bill_total / sum(tax_bill_total) OVER w AS tax_bill_total
  FROM tax_base WINDOW w AS (PARTITION BY year)),
tax_long AS (
  SELECT major_class_type, year, 1 AS name_ord, 'Assessed value (mailed)' AS name, av_mailed AS value FROM tax_base
  UNION ALL SELECT major_class_type, year, 2, 'Assessed value (Board of Review)', av_board FROM tax_base
  UNION ALL SELECT major_class_type, year, 3, 'Tax bills', tax_bill_total FROM tax_base),
share_long AS (
  SELECT major_class_type, year, 1 AS name_ord, 'Assessed value (mailed)' AS name, av_mailed AS value FROM tax_share
  UNION ALL SELECT major_class_type, year, 2, 'Assessed value (Board of Review)', av_board FROM tax_share
  UNION ALL SELECT major_class_type, year, 3, 'Tax bills', tax_bill_total FROM tax_share)
"""

STUDY = """
dated AS (
  SELECT CASE WHEN length(pin) < 14 THEN lpad(pin, 14, '0') ELSE pin END AS pin, year, sale_date, sale_price, sale_key,
         try_strptime(sale_date, '%B %d %Y') AS sold
  FROM sales WHERE year >= 2006),
latest AS (
  SELECT pin, year, sale_date, sale_price, sale_key FROM (
    SELECT *, row_number() OVER (PARTITION BY pin, year ORDER BY sold DESC, sale_key DESC) AS rn FROM dated WHERE sold IS NOT NULL)
  WHERE rn = 1),
base AS (
  SELECT CASE WHEN length(r.pin) < 14 THEN lpad(r.pin, 14, '0') ELSE r.pin END AS pin, r.year, r.tax_code_num, r.class,
         r.tax_bill_total, r.av_mailed, r.av_certified, r.av_board, r.av_clerk, r.reporting_group, r.township_code,
         r.triad_name, s.sale_price, s.sale_key, r.av_mailed / s.sale_price AS av_ratio_mailed,
         r.av_certified / s.sale_price AS av_ratio_certified, r.av_board / s.sale_price AS av_ratio_board,
         r.av_clerk / s.sale_price AS av_ratio_clerk
  FROM roll r JOIN latest s
    ON CASE WHEN length(r.pin) < 14 THEN lpad(r.pin, 14, '0') ELSE r.pin END = s.pin AND r.year = s.year
  WHERE r.regression_class),
cuts AS (
  SELECT year, township_code, class,
         quantile_cont(av_ratio_mailed, [0.25, 0.75, 0.01, 0.99, 0.02, 0.98, 0.03, 0.97, 0.04, 0.96, 0.05, 0.95]) AS q
  FROM base GROUP BY year, township_code, class),
flagged AS (
  SELECT b.*,
         CASE WHEN av_ratio_mailed > q[1] - 1.5::DOUBLE * (q[2] - q[1]) AND av_ratio_mailed < q[2] + 1.5::DOUBLE * (q[2] - q[1])
              THEN 1 ELSE 0 END AS outlier_flag_iaao,
         CASE WHEN av_ratio_mailed < q[3] OR av_ratio_mailed > q[4] THEN 0 ELSE 1 END AS av_ratio_1_to_99,
         CASE WHEN av_ratio_mailed < q[5] OR av_ratio_mailed > q[6] THEN 0 ELSE 1 END AS av_ratio_2_to_98,
         CASE WHEN av_ratio_mailed < q[7] OR av_ratio_mailed > q[8] THEN 0 ELSE 1 END AS av_ratio_3_to_97,
         CASE WHEN av_ratio_mailed < q[9] OR av_ratio_mailed > q[10] THEN 0 ELSE 1 END AS av_ratio_4_to_96,
         CASE WHEN av_ratio_mailed < q[11] OR av_ratio_mailed > q[12] THEN 0 ELSE 1 END AS av_ratio_5_to_95
  FROM base b JOIN cuts c ON b.year = c.year AND b.township_code = c.township_code AND b.class = c.class),
adjusted AS (
  SELECT f.*, p.case_shiller, p.hpi,
         tax_bill_total * case_shiller AS tax_bill_total_case_shiller, sale_price * case_shiller AS sale_price_case_shiller,
         av_mailed * case_shiller AS av_mailed_case_shiller, av_certified * case_shiller AS av_certified_case_shiller,
         av_board * case_shiller AS av_board_case_shiller, av_clerk * case_shiller AS av_clerk_case_shiller,
         tax_bill_total * hpi AS tax_bill_total_hpi, sale_price * hpi AS sale_price_hpi, av_mailed * hpi AS av_mailed_hpi,
         av_certified * hpi AS av_certified_hpi, av_board * hpi AS av_board_hpi, av_clerk * hpi AS av_clerk_hpi,
         tax_bill_total / sale_price AS effective_tax_rate
  FROM flagged f LEFT JOIN prices p ON f.year = p.year),
grouped AS (
  SELECT * EXCLUDE (term), term AS assessor_term, coalesce(term, 'NA') || ' ' || CAST(year AS VARCHAR) AS assessor_term_year
  FROM (
    SELECT *, CASE WHEN year BETWEEN 1998 AND 2010 THEN 'Houlihan' WHEN year BETWEEN 2011 AND 2018 THEN 'Berrios'
                WHEN year BETWEEN 2019 AND 2024 THEN 'Kaegi' END AS term,
      CASE WHEN year = 2022 THEN '2022' WHEN year IN (2018, 2021) THEN '2018 vs. 2021'
           WHEN year IN (2017, 2020) THEN '2017 vs. 2020' WHEN year IN (2016, 2019) THEN '2016 vs. 2019'
           ELSE 'Before 2015' END AS comparison_years2,
      CASE WHEN year IN (2019, 2022) THEN '2019 vs. 2022' WHEN year IN (2018, 2021) THEN '2018 vs. 2021'
           WHEN year IN (2017, 2020) THEN '2017 vs. 2020' ELSE 'Before 2016' END AS comparison_years3,
      CASE WHEN year IN (2018, 2021) THEN '2018 vs. 2021' WHEN year IN (2017, 2020) THEN '2017 vs. 2020'
           WHEN year IN (2016, 2022) THEN '2016 vs. 2022' ELSE 'Before 2015' END AS comparison_years,
      CASE reporting_group WHEN 'Single-Family' THEN 1 WHEN 'Multi-Family' THEN 2 WHEN 'Condominium' THEN 3 END AS reporting_group_ord
    FROM adjusted WHERE reporting_group <> 'Bed & Breakfast')),
scored AS (
  SELECT *, abs((sale_price_hpi - avg(sale_price_hpi) OVER w) / stddev_samp(sale_price_hpi) OVER w) AS zscore
  FROM grouped WINDOW w AS (PARTITION BY reporting_group)),
clean AS (
  SELECT * FROM scored
  WHERE outlier_flag_iaao = 1 AND zscore < 3 AND year >= 2006 AND av_mailed > 100 AND sale_price > 100),
own AS (
  SELECT * FROM clean WHERE year >= 2016 AND (
    (triad_name = 'City' AND comparison_years = '2018 vs. 2021') OR (triad_name = 'North' AND comparison_years = '2016 vs. 2022')
    OR (triad_name = 'South' AND comparison_years = '2017 vs. 2020'))),
profile_county AS (
  SELECT sales_ntile, reporting_group, comparison_years, assessor_term, assessor_term_year, count(*) AS "count",
         avg(av_ratio_mailed) AS av_ratio_mailed, avg(sale_price) AS sale_price, avg(sale_price_hpi) AS sale_price_hpi
  FROM (SELECT *, CAST(ntile(100) OVER (PARTITION BY year, reporting_group ORDER BY sale_price_hpi, pin) AS INTEGER) AS sales_ntile FROM own)
  GROUP BY ALL),
profile_triad AS (
  SELECT sales_ntile, reporting_group, triad_name, comparison_years, assessor_term, assessor_term_year,
         count(*) AS "count", avg(av_ratio_mailed) AS av_ratio_mailed, avg(sale_price) AS sale_price,
         avg(sale_price_hpi) AS sale_price_hpi
  FROM (SELECT *, CAST(ntile(100) OVER (PARTITION BY year, triad_name, reporting_group ORDER BY sale_price_hpi, pin) AS INTEGER) AS sales_ntile
        FROM clean WHERE year >= 2016)
  GROUP BY ALL),
board AS (
  SELECT year, sales_ntile, assessor_term, count(*) AS "count", avg(av_mailed_hpi) AS av_mailed_hpi,
         avg(av_board_hpi) AS av_board_hpi, avg(av_ratio_mailed) AS av_ratio_mailed, avg(av_ratio_board) AS av_ratio_board,
         avg(sale_price) AS sale_price, avg(sale_price_hpi) AS sale_price_hpi
  FROM (SELECT *, CAST(ntile(100) OVER (PARTITION BY year ORDER BY sale_price_hpi, pin) AS INTEGER) AS sales_ntile
        FROM clean WHERE year >= 2019)
  GROUP BY ALL),
board_wide AS (
  SELECT year, sales_ntile, assessor_term, "count", sale_price, sale_price_hpi, av_mailed_hpi, av_board_hpi,
         av_ratio_mailed, av_ratio_board, av_board_hpi / av_mailed_hpi AS assessed_value_board_mailed_ratio,
         av_board_hpi - av_mailed_hpi AS assessed_value_board_mailed_diff,
         (av_board_hpi - av_mailed_hpi) / av_mailed_hpi AS assessed_value_board_mailed_diff_pct
  FROM board),
board_long AS (
  SELECT * FROM (UNPIVOT board_wide ON av_mailed_hpi, av_board_hpi, av_ratio_mailed, av_ratio_board,
    assessed_value_board_mailed_ratio, assessed_value_board_mailed_diff, assessed_value_board_mailed_diff_pct
    INTO NAME name VALUE value)),
medians AS (SELECT year, median(av_ratio_mailed) AS med FROM clean GROUP BY year),
cod AS (
  SELECT year, sum(abs(av_ratio_mailed - med)) / count(*) / any_value(med) AS cod, count(*) AS n
  FROM clean JOIN medians USING (year) GROUP BY year),
prd AS (
  SELECT year, avg(av_ratio_mailed) AS mean_av, median(av_ratio_mailed) AS median_av,
         sum(av_ratio_mailed * sale_price_hpi) / sum(sale_price_hpi) AS weighted_mean_av,
         avg(av_ratio_mailed) / (sum(av_ratio_mailed * sale_price_hpi) / sum(sale_price_hpi)) AS prd, count(*) AS n
  FROM clean GROUP BY year),
prb_terms AS (
  SELECT year, (av_ratio_mailed - med) / med AS y, log2(0.5::DOUBLE * (av_mailed / med) + 0.5::DOUBLE * sale_price) AS x
  FROM clean JOIN medians USING (year)),
prb_fit AS (
  SELECT year, regr_intercept(y, x) AS intercept, regr_slope(y, x) AS est, regr_sxx(y, x) AS sxx,
         regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS rss, count(*) AS n
  FROM prb_terms GROUP BY year)
"""

AREAS = """
race AS (
  SELECT geoid, CASE variable WHEN 'B03002_012' THEN 'Latino/a' WHEN 'B03002_003' THEN 'White' WHEN 'B03002_004' THEN 'Black'
           WHEN 'B03002_005' THEN 'Native American' WHEN 'B03002_006' THEN 'Asian/Pacific Islander'
           WHEN 'B03002_007' THEN 'Asian/Pacific Islander' WHEN 'B03002_008' THEN 'Multiracial/Other'
           WHEN 'B03002_009' THEN 'Multiracial/Other' ELSE '' END AS race,
         summary_est, sum(estimate) AS estimate
  FROM acs_race GROUP BY ALL),
plurality AS (
  SELECT geoid, race AS plurality_race, estimate AS plurality_race_population, estimate / summary_est AS plurality_race_share
  FROM (SELECT *, row_number() OVER (PARTITION BY geoid ORDER BY estimate / summary_est DESC, race) AS rn FROM race)
  WHERE rn = 1 AND estimate > 0),
one_point AS (
  SELECT pin10, longitude AS x, latitude AS y FROM (
    SELECT *, row_number() OVER (PARTITION BY pin10 ORDER BY longitude, latitude) AS rn FROM pin_points) WHERE rn = 1),
pin_area AS (
  SELECT pin10, geoid FROM one_point, edges
  WHERE (ay > y) <> (by_ > y) AND x < ax + (bx - ax) * (y - ay) / (by_ - ay)
  GROUP BY pin10, geoid HAVING count(*) % 2 = 1),
area_sums AS (
  SELECT geoid, year, assessor_term, comparison_years, assessor_term_year, triad_name,
         sum(tax_bill_total_hpi) AS tax_bill_total_hpi, sum(sale_price_hpi) AS sale_price_hpi,
         sum(av_mailed_hpi) AS av_mailed_hpi, sum(av_certified_hpi) AS av_certified_hpi,
         sum(av_board_hpi) AS av_board_hpi, sum(av_clerk_hpi) AS av_clerk_hpi,
         sum(av_mailed_hpi) / sum(sale_price_hpi) AS av_ratio_mailed, sum(av_board_hpi) / sum(sale_price_hpi) AS av_ratio_board,
         sum(av_board_hpi) - sum(av_mailed_hpi) AS av_board_mailed_diff
  FROM own LEFT JOIN pin_area ON substr(own.pin, 1, 10) = pin_area.pin10
  GROUP BY geoid, year, assessor_term, comparison_years, assessor_term_year, triad_name),
area_ratios AS (
  SELECT g.geoid, g.estimate AS median_income, s.* EXCLUDE (geoid), p.* EXCLUDE (geoid)
  FROM block_groups g LEFT JOIN area_sums s ON g.geoid = s.geoid LEFT JOIN plurality p ON g.geoid = p.geoid)
"""

REGIONS = """
links AS (
  SELECT a.geoid AS a, b.geoid AS b, a.category, b.category AS category_b FROM tiles a JOIN tiles b
    ON (b.cx = a.cx + 1 AND b.cy = a.cy) OR (b.cx = a.cx AND b.cy = a.cy + 1)),
walk AS (
  SELECT geoid AS id, geoid AS seen FROM tiles
  UNION
  SELECT w.id, CASE WHEN l.a = w.seen THEN l.b ELSE l.a END
  FROM walk w JOIN links l ON (l.a = w.seen OR l.b = w.seen) AND l.category = l.category_b),
clustered AS (
  SELECT t.*, c.cluster_id, (cx * 0.02::DOUBLE + (cx + 1) * 0.02::DOUBLE) / 2 AS mx, (cy * 0.02::DOUBLE + (cy + 1) * 0.02::DOUBLE) / 2 AS my,
         ((cx + 1) * 0.02::DOUBLE - cx * 0.02::DOUBLE) * ((cy + 1) * 0.02::DOUBLE - cy * 0.02::DOUBLE) AS area
  FROM tiles t JOIN (SELECT id, min(seen) AS cluster_id FROM walk GROUP BY id) c ON t.geoid = c.id),
cluster_area AS (
  SELECT cluster_id, category, sum(area) AS area, avg(mx) AS cx, avg(my) AS cy, count(*) AS cells
  FROM clustered GROUP BY cluster_id, category),
kept AS (
  SELECT cluster_id, category, area, cx, cy, area_share FROM (
    SELECT *, row_number() OVER (PARTITION BY category ORDER BY CAST(area AS FLOAT) DESC, cluster_id) AS rn,
           area / sum(area) OVER () AS area_share FROM cluster_area)
  WHERE rn <= 2 OR area_share >= 0.01)
"""


def with_tables(query: str, regions: bool = False) -> str:
    parts = [FIXTURES, ROLLS, STUDY, AREAS] + ([REGIONS] if regions else [])
    body = ",\n".join(p.strip() for p in parts)
    return f"WITH {'RECURSIVE ' if regions else ''}{body}\n{query}"
