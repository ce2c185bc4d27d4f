"""lumenfold: a lazy, expression-based analytics layer over PySpark DataFrames."""

from lumenfold.functions import selectors
from lumenfold.functions.expr import (
    Expr,
    SortKey,
    all_,
    all_horizontal,
    any_horizontal,
    arg_sort_by,
    arg_where,
    asc,
    coalesce,
    col,
    col_dtype,
    col_regex,
    concat_arr,
    concat_list,
    concat_str,
    concat_str_ignore_nulls,
    corr,
    cov,
    cum_fold,
    cum_reduce,
    cum_sum_horizontal,
    desc,
    element,
    exclude,
    exclude_regex,
    fold,
    format_,
    hash_rows,
    is_duplicated,
    is_unique,
    length,
    lit,
    max_horizontal,
    mean_horizontal,
    min_horizontal,
    nth,
    null,
    reduce,
    rolling_corr,
    rolling_cov,
    spearman,
    struct,
    sum_horizontal,
    when,
)
from lumenfold.functions.lists import date_ranges, datetime_ranges, int_ranges, linear_spaces, ones, repeat, time_ranges, zeros
from lumenfold.functions.temporal import (
    business_day_count,
    from_epoch,
    make_date,
    make_datetime,
    make_duration,
    make_time,
)
from lumenfold.operators.frame import Frame, GroupBy, Rolling
from lumenfold.operators.joins import interval_join
from lumenfold.operators.reshape import concat
from lumenfold.operators.temporal import Interval, every

__all__ = [
    "Expr", "Frame", "GroupBy", "Interval", "Rolling", "SortKey", "all_", "all_horizontal", "any_horizontal", "arg_sort_by", "arg_where", "asc", "business_day_count",
    "coalesce", "col", "col_dtype", "col_regex", "concat", "concat_arr", "concat_list", "concat_str", "concat_str_ignore_nulls", "corr", "cov",
    "cum_fold", "cum_reduce", "cum_sum_horizontal", "date_ranges", "datetime_ranges", "desc", "element", "every", "exclude", "exclude_regex",
    "fold", "format_", "from_epoch", "hash_rows", "int_ranges", "interval_join", "is_duplicated", "is_unique", "length", "linear_spaces", "lit",
    "make_date", "make_datetime", "make_duration", "make_time", "max_horizontal", "mean_horizontal", "min_horizontal", "nth", "null", "ones",
    "reduce", "repeat", "rolling_corr", "rolling_cov", "selectors", "spearman", "struct", "sum_horizontal", "time_ranges", "when", "zeros",
]
