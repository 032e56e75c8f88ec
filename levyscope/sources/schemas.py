"""Schemas of the study's inputs; every reader names its schema instead of inferring one."""

SALES = "pin string, year int, sale_date string, sale_price double, sale_key bigint, class string, township_code int"
ASSESSMENTS = (
    "year int, pin string, tax_code_num string, class string, tax_bill_total double, "
    "av_mailed double, av_certified double, av_board double, av_clerk double"
)
CLASS_DICT = "class_code string, reporting_group string, major_class_type string, regression_class boolean"
TOWNSHIPS = "township_code string, triad_name string"
APPEALS = (
    "TAX_YEAR int, CLASS double, TOWNSHIP_CODE int, RESULT string, "
    "ASSESSOR_TOTALVALUE double, BOR_TOTALVALUE double"
)
ACS_LONG = "GEOID string, variable string, estimate double, summary_est double"
POLYGONS = "geoid string, estimate double, ring array<struct<x: double, y: double>>"
# areas of several parts, or with holes: any ring inside an odd number of others is a hole
MULTIPOLYGONS = "geoid string, estimate double, rings array<array<struct<x: double, y: double>>>"
POINTS = "pin10 string, longitude double, latitude double"
