"""Training job: fits and stores the segmentation, classification and regression models.

    spark-submit -m paceframe.plans.train PROCESSED_PATH MODELS_DIR --size light
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from paceframe.operators import models
from paceframe.session import build_session
from paceframe.sources.readers import read_processed


def train_all(df: DataFrame, models_dir: str, size: models.ForestSize = models.LIGHT) -> dict[str, str]:
    """Fits the three models on all rows and stores each below ``models_dir``."""
    paths = {n: f"{models_dir}/{n}" for n in ("activity_classifier", "calories_regressor", "user_segmentation")}
    classifier = models.fit_forest_classifier(df, size=size)
    models.save_model(classifier, paths["activity_classifier"], models.CLASSIFIER_FEATURES)
    regressor = models.fit_forest_regressor(df, size=size)
    models.save_model(
        regressor, paths["calories_regressor"], (*models.REGRESSOR_FEATURES, "activity_type")
    )
    segments = models.fit_segments_restarts(models.profiles_of(df))
    models.save_model(segments, paths["user_segmentation"], models.PROFILE_FEATURES)
    return paths


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("processed_path")
    parser.add_argument("models_dir")
    parser.add_argument("--size", choices=("light", "full"), default="light")
    options = parser.parse_args(argv)
    spark = build_session("paceframe-train")
    size = models.LIGHT if options.size == "light" else models.FULL
    for name, path in train_all(read_processed(spark, options.processed_path), options.models_dir, size).items():
        print(f"{name}: {path}")


if __name__ == "__main__":
    main()
