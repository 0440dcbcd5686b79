"""Association-rule mining over the cleaned incidents.

select the five basket columns -> drop rows with a NULL or a placeholder
(``Unknown``/``Other``) -> one basket per incident -> deterministic 80/20
split by key -> FP-growth on the training part -> itemsets, rules, and the
rules applied to the held-out part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowthModel
from pyspark.sql import Column, DataFrame

from blotter.operators import classify, patterns
from blotter.operators.clean import filter_placeholders
from blotter.schema import BASKET_COLUMNS
from blotter.session import stored


@dataclass
class RuleMining:
    model: FPGrowthModel
    train: DataFrame
    test: DataFrame

    def itemsets(self) -> DataFrame:
        return patterns.freq_itemsets(self.model)

    def rules(self) -> DataFrame:
        return patterns.assoc_rules(self.model)

    def predictions(self) -> DataFrame:
        return patterns.apply_rules(self.model, self.test)

    def release(self) -> None:
        patterns.release(self.model)


def incident_baskets(clean: DataFrame, key: str | Column, columns: list[str] = BASKET_COLUMNS) -> DataFrame:
    """(``key``, ``items``) for every incident with five known, non-placeholder values."""
    kept = filter_placeholders(clean, columns)
    return kept.select(key if isinstance(key, Column) else kept[key], patterns.basket(columns).alias("items"))


def mine_rules(baskets: DataFrame, key: str, min_support: float = 0.2, min_confidence: float = 0.5,
               train_percent: int = 80, salt: int = 0) -> RuleMining:
    """Defaults are the reference's thresholds (support 0.2, confidence 0.5, 80/20 split).

    The baskets are computed once, into the shared folder: mining reads them several times, and the rules are applied to their test part.
    """
    baskets = stored(baskets, "rule-baskets")
    train, test = classify.key_split(baskets, key, train_percent, salt)
    model = patterns.mine(train, min_support, min_confidence)
    return RuleMining(model, train, test)
