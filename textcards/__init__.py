"""textcards: evidence-grounded multi-label text labelling on Spark.

Every public function is either a ``Column -> Column`` expression builder
(``textcards.functions``) or a ``DataFrame -> DataFrame`` operator
(``textcards.operators``).  Nothing collects record data to the driver;
only bounded things (lexicons, taxonomies, cut points, metric rows) are.
"""

from textcards.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
