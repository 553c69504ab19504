"""All public operators in one place, under the names that array code uses."""

from gridloom.errors import DimensionMismatch
from gridloom.functions.literals import get_backend, i8, i16, i32, i64, int_linspace, synchronize, typed, u8, u16, u32, u64
from gridloom.functions.monoids import neutral_element
from gridloom.functions.monoids import own_monoid as monoid
from gridloom.functions.tuning import Tuning
from gridloom.model import DArray, Scalar
from gridloom.operators.arithmetic import count, maximum, minimum, prod, sum
from gridloom.operators.elementwise import compact, foraxes, foreachindex, map, map_, reverse, reverse_
from gridloom.operators.partition import TaskPartitioner, itask_partition, task_partition
from gridloom.operators.predicates import all, any
from gridloom.operators.reduce import mapreduce, reduce, zipped
from gridloom.operators.scan import accumulate, accumulate_, cumprod, cumsum
from gridloom.operators.search import searchsortedfirst, searchsortedfirst_, searchsortedlast, searchsortedlast_
from gridloom.operators.sort import (
    merge_sort,
    merge_sort_,
    merge_sort_by_key,
    merge_sort_by_key_,
    merge_sortperm,
    merge_sortperm_,
    merge_sortperm_lowmem,
    merge_sortperm_lowmem_,
    radix_sort,
    radix_sort_,
    sample_sort,
    sample_sort_,
    sample_sortperm,
    sample_sortperm_,
    sort,
    sort_,
    sort_by_key,
    sortperm,
    sortperm_,
)
from gridloom.plans.opaque import opaque
from gridloom.sources import from_array_column, from_range, from_rows, from_table, from_values, to_table

__all__ = [name for name in dir() if not name.startswith("_")]
