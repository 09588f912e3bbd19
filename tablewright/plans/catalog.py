"""The vocabulary of cleaning actions, by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Stages, action labels and their descriptions, in order.
ACTIONS = {
    "missing-values-handling": {
        "drop_rows": "Remove rows containing missing values in selected columns.",
        "mean_imputation": "Replace missing numeric values with the mean of observed values.",
        "median_imputation": "Replace missing numeric values with the median to reduce outlier sensitivity.",
        "mode_imputation": "Replace missing values with the most frequent observed value.",
        "constant_imputation": "Replace missing values with a fixed constant such as zero or a sentinel value.",
        "forward_fill": "Propagate the last valid observation forward to fill missing values.",
        "backward_fill": "Propagate the next valid observation backward to fill missing values.",
        "interpolation_linear": "Estimate missing values using linear interpolation between neighboring points.",
        "interpolation_time": "Interpolate missing values using time-based indexing for temporal data.",
        "knn_imputation": "Impute missing values using k-nearest neighbors based on feature similarity.",
        "iterative_imputation": "Iteratively model each feature with missing values as a function of other features.",
        "regression_imputation": "Predict missing values using a regression model trained on observed data.",
    },
    "outlier-handling": {
        "iqr_clipping": "Cap values outside the interquartile range using lower and upper bounds.",
        "zscore_clipping": "Cap or flag values exceeding a specified z-score threshold.",
        "winsorization": "Replace extreme values with percentile-based boundary values.",
        "isolation_forest_detection": "Identify outliers using an ensemble-based isolation forest model.",
        "local_outlier_factor": "Detect anomalous points based on local density deviations.",
        "dbscan_outlier_removal": "Identify and remove noise points using density-based clustering.",
        "robust_scaling": "Reduce outlier influence by scaling features using robust statistics.",
    },
    "encoding": {
        "one_hot_encoding": "Encode categorical variables as binary indicator columns.",
        "ordinal_encoding": "Encode ordered categorical variables using integer rankings.",
        "label_encoding": "Encode categorical values as integer labels without preserving order.",
        "target_encoding": "Encode categories using aggregated target statistics.",
        "frequency_encoding": "Encode categories based on observed frequency.",
        "binary_encoding": "Encode categories using binary representations to reduce dimensionality.",
        "hashing_trick": "Map categorical values to a fixed-dimensional space using a hash function.",
    },
    "scaling-normalization": {
        "min_max_scaling": "Scale features to a fixed range, typically between zero and one.",
        "standard_scaling": "Standardize features to zero mean and unit variance.",
        "robust_scaling": "Scale features using median and interquartile range for robustness to outliers.",
        "max_abs_scaling": "Scale features by their maximum absolute value.",
        "log_transform": "Apply a logarithmic transformation to reduce skewness in distributions.",
        "power_transform_yeo_johnson": "Apply a power transformation to stabilize variance and normalize distributions.",
        "quantile_transform": "Transform features to follow a uniform or normal distribution.",
    },
    "binning-discretization": {
        "equal_width_binning": "Discretize continuous values into bins of equal width.",
        "equal_frequency_binning": "Discretize values so each bin contains approximately equal observations.",
        "quantile_binning": "Create bins based on specified quantiles of the data distribution.",
        "kmeans_binning": "Use k-means clustering to define bin boundaries.",
        "decision_tree_binning": "Learn bin thresholds using decision tree splits.",
        "custom_threshold_binning": "Discretize values using predefined domain-specific thresholds.",
    },
    "feature-construction": {
        "polynomial_features": "Generate polynomial combinations of numeric features.",
        "interaction_terms": "Create features representing interactions between existing variables.",
        "ratio_features": "Derive new features as ratios between numeric variables.",
        "aggregation_features": "Compute aggregated statistics over grouped dimensions.",
        "lag_features": "Create lagged versions of variables for temporal modeling.",
        "rolling_window_features": "Compute rolling statistics over a defined window size.",
        "date_part_features": "Extract calendar-based features such as weekday, month, or quarter.",
    },
    "dimensionality-reduction": {
        "pca": "Reduce dimensionality using principal component analysis.",
        "incremental_pca": "Apply PCA in batches for large or streaming datasets.",
        "kernel_pca": "Perform non-linear dimensionality reduction using kernel methods.",
        "truncated_svd": "Reduce dimensionality using truncated singular value decomposition.",
        "autoencoder_projection": "Learn a low-dimensional representation using neural autoencoders.",
        "variance_threshold": "Remove features with variance below a specified threshold.",
        "correlation_filtering": "Drop features that are highly correlated with others.",
    },
}


def action_catalog(spark: SparkSession, stage: str | None = None) -> DataFrame:
    """``(stage, stage_pos, action, action_pos, description)``; an unknown stage is an error."""
    if stage is not None and stage not in ACTIONS:
        raise KeyError(f"Unknown transformation stage '{stage}'")
    rows = [
        F.struct(
            F.lit(s).alias("stage"),
            F.lit(i).alias("stage_pos"),
            F.lit(a).alias("action"),
            F.lit(j).alias("action_pos"),
            F.lit(text).alias("description"),
        )
        for i, (s, actions) in enumerate(ACTIONS.items())
        for j, (a, text) in enumerate(actions.items())
        if stage in (None, s)
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("a")).select("a.*")


def action_labels(stage: str) -> list[str]:
    """The labels of a stage, in order."""
    if stage not in ACTIONS:
        raise KeyError(f"Unknown transformation stage '{stage}'")
    return list(ACTIONS[stage])


def action_summary(stage: str) -> str:
    """One ``label: description`` line per action of a stage."""
    return "".join(f"{a}: {ACTIONS[stage][a]}\n" for a in action_labels(stage))
