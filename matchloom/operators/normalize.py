"""Normalized records: canonical fields with the keys and features that blocking, comparison and rules use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X


def normalize(df: DataFrame) -> DataFrame:
    """Canonical records with name_full, name_key, name_form, name_gen, name_gen_rank, name_nums, name_ord, name_dir,
    dba_key, division_key, street_key, street_num, street_name, street_type, street_unit, is_po_box, zip3, zip9 and
    state_abb added and zip5 rewritten. A missing name or street gives '' as key, which is similar to nothing.

    Only built-in expressions: the whole step is one stage without a shuffle. Two projections, so that the cleaned name
    and street are computed once."""
    first = df.withColumns({"name_full": X.name_full(F.col("name")), "street_key": X.street_key(F.col("street")), "__dba": X.name_full(F.col("dba")), "__div": X.name_full(F.col("division"))})
    full = F.col("name_full")
    zips = X.zip_parts(F.col("zip5"), F.col("zip_plus4"))
    return first.withColumns({
        "name_key": X.name_key(full), "name_form": X.name_form(full), "name_gen": X.generation(full),
        "name_gen_rank": X.lookup(K.GENERATIONS, X.generation(full)), "name_nums": X.numbers(full),
        "name_ord": X.mapped_tokens(full, K.ORDINAL_RANKS), "name_dir": X.mapped_tokens(full, K.NAME_DIRECTIONS),
        "dba_key": X.name_key(F.col("__dba")), "division_key": X.name_key(F.col("__div")),
        "street_unit": X.street_unit(F.col("street")), "is_po_box": F.col("street_key").rlike(K.BOX_PATTERN),
        **X.street_parts(F.col("street_key")), **zips, "state_abb": X.state_code(F.col("state")),
    }).drop("__dba", "__div")
