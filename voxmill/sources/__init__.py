"""Datasets and file loading."""

from .dataset import AsyncDataset, Dataset, images, load_paths

__all__ = ["AsyncDataset", "Dataset", "images", "load_paths"]
