"""Sales fact -> wide feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfcast.operators import features as f


def build_features(fact: DataFrame) -> DataFrame:
    """All feature groups of a stored fact. The two steps that shuffle the fact run first, while
    its rows are narrow; the rest only adds columns or joins broadcast tables. The label, date
    and store tables are taken from the fact as it came in, so that none of them waits for
    columns added here."""
    shuffled = fact.transform(f.add_store_day_totals) if "onpromotion" in fact.columns else fact
    return (
        shuffled.transform(f.add_lag_features)
        .transform(f.add_time_features)
        .transform(f.add_store_features, source=fact)
        .transform(f.add_external_features, source=fact)
        .transform(f.smart_fill)
    )
