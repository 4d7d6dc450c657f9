from tidewise.functions.ratios import (round_div, round_div_decimal, pct, growth_pct,
                                       safe_divide)
from tidewise.functions.parse import (is_missing, parse_number_es, split_code_label,
                                      parse_period, map_patterns, empty_to_null,
                                      format_number_es)
from tidewise.functions.labels import classify_expr, band_expr

__all__ = ["round_div", "round_div_decimal", "pct", "growth_pct", "safe_divide",
           "is_missing", "parse_number_es", "split_code_label", "parse_period",
           "map_patterns", "empty_to_null", "format_number_es", "classify_expr", "band_expr"]
