"""Fine-tuning data preparation and evaluation as PySpark DataFrame and Column functions."""

from sftprep.config import (
    BatchSpec,
    ChatMarkers,
    ColumnNames,
    Recipe,
    SplitSpec,
    TokenSpec,
)

__all__ = ["BatchSpec", "ChatMarkers", "ColumnNames", "Recipe", "SplitSpec", "TokenSpec"]
