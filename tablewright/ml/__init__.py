"""Training and evaluation of models on Spark."""
from .history import append_run, best_runs, delete_run, read_runs
from .metrics import (classification_metrics, clustering_metrics, confusion_matrix, regression_metrics)
from .models import ALGORITHMS, fit_model
from .prepare import prepare, split_rows
from .train import train

__all__ = ["ALGORITHMS", "append_run", "best_runs", "classification_metrics", "clustering_metrics", "confusion_matrix",
           "delete_run", "fit_model", "prepare", "read_runs", "regression_metrics", "split_rows", "train"]
