"""Layered warehouse operators for Spark: load, stage, reshape, model, expose, test and monitor tables."""

from .session import get_spark, new_folder, remove_folders, shared_folder

__all__ = ["get_spark", "new_folder", "remove_folders", "shared_folder"]
