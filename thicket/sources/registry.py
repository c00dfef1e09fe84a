"""Registry of public benchmark data sets: names, files and how to load them from a local folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .files import read_json_lines, read_libsvm, read_xy_sparse

#: Key, printed name, feature forms with their file formats, and subsets of the public data sets.
DATASETS = {
    "yeast": {"name": "yeast", "formats": {"bow": "libsvm"}, "subsets": ["train", "test"]},
    "mediamill": {"name": "mediamill", "formats": {"bow": "libsvm"}, "subsets": ["train", "test"]},
    "rcv1-2k": {"name": "RCV1-2K", "formats": {"bow": "libsvm"}, "subsets": ["train", "test"]},
    "eurlex-4k": {"name": "EURLex-4K", "formats": {"bow": "libsvm"}, "subsets": ["train", "test"]},
    "eurlex-4.3k": {"name": "EURLex-4.3K", "formats": {"bow": "libsvm"}, "subsets": ["train", "test", "validation"]},
    "amazoncat-13k": {"name": "AmazonCat-13K", "formats": {"bow-v1": "libsvm", "bow": "libsvm", "raw": "jsonlines"}, "subsets": ["train", "test"]},
    "amazoncat-14k": {"name": "AmazonCat-14K", "formats": {"bow-v1": "libsvm", "bow": "libsvm", "raw": "jsonlines"}, "subsets": ["train", "test"]},
    "wiki10-31k": {"name": "Wiki10-31K", "formats": {"bow-v1": "libsvm", "bow": "libsvm"}, "subsets": ["train", "test"]},
    "deliciouslarge-200k": {"name": "DeliciousLarge-200K", "formats": {"bow": "libsvm"}, "subsets": ["train", "test"]},
    "wikilshtc-325k": {"name": "WikiLSHTC-325K", "formats": {"bow": "libsvm"}, "subsets": ["train", "test"]},
    "wikiseealsotitles-350k": {"name": "WikiSeeAlsoTitles-350K", "formats": {"bow": "XY_sparse", "raw": "jsonlines"}, "subsets": ["train", "test"]},
    "wikititles-500k": {"name": "WikiTitles-500K", "formats": {"bow": "XY_sparse", "raw": "jsonlines"}, "subsets": ["train", "test"]},
    "wikipedialarge-500k": {"name": "WikipediaLarge-500K", "formats": {"bow": "libsvm", "raw": "jsonlines"}, "subsets": ["train", "test"]},
    "amazontitles-670k": {"name": "AmazonTitles-670K", "formats": {"bow": "XY_sparse", "raw": "jsonlines"}, "subsets": ["train", "test"]},
    "amazon-670k": {"name": "Amazon-670K", "formats": {"bow-v1": "libsvm", "bow": "libsvm", "raw": "jsonlines"}, "subsets": ["train", "test"]},
    "amazontitles-3m": {"name": "AmazonTitles-3M", "formats": {"bow": "XY_sparse", "raw": "jsonlines"}, "subsets": ["train", "test"]},
    "amazon-3m": {"name": "Amazon-3M", "formats": {"bow-v1": "libsvm", "bow": "libsvm", "raw": "jsonlines"}, "subsets": ["train", "test"]},
    "lf-amazontitles-131k": {"name": "LF-AmazonTitles-131K", "formats": {"bow": "libsvm"}, "subsets": ["train", "test"]},
    "lf-amazon-131k": {"name": "LF-Amazon-131K", "formats": {"bow": "libsvm"}, "subsets": ["train", "test"]},
    "lf-wikiseealsotitles-320k": {"name": "LF-WikiSeeAlsoTitles-320K", "formats": {"bow": "libsvm"}, "subsets": ["train", "test"]},
    "lf-wikiseealso-320k": {"name": "LF-WikiSeeAlso-320K", "formats": {"bow": "libsvm"}, "subsets": ["train", "test"]},
    "lf-wikititles-500k": {"name": "LF-WikiTitles-500K", "formats": {"bow": "libsvm"}, "subsets": ["train", "test"]},
    "lf-amazontitles-1.3m": {"name": "LF-AmazonTitles-1.3M", "formats": {"bow": "libsvm"}, "subsets": ["train", "test"]},
}


def dataset_meta(dataset: str, format: str = "bow") -> dict:
    """The entry of a data set by any spelling of its name; ``tf-idf`` is another name for ``bow``."""
    key = dataset.lower().replace("_", "-")
    if key not in DATASETS:
        raise ValueError(f"Dataset {dataset} is not available")
    e = DATASETS[key]
    form = "bow" if format in ("tf-idf", "tfidf") else format
    if form not in e["formats"]:
        raise ValueError(f"Dataset {dataset} has no format {format}; it has {sorted(e['formats'])}")
    return {"key": key, "name": e["name"], "format": form, "file_format": e["formats"][form], "subsets": e["subsets"]}


def load_dataset(spark: SparkSession, dataset: str, subset: str = "train", format: str = "bow", root: str = "./data") -> DataFrame:
    """Load a subset that lies under ``root/<name>_<format>/``; nothing is downloaded."""
    m = dataset_meta(dataset, format)
    if subset not in m["subsets"]:
        raise ValueError(f"Subset {subset} is not one of {m['subsets']}")
    base = os.path.join(root, f"{m['key']}_{m['format']}")
    if m["file_format"] == "libsvm":
        return read_libsvm(spark, os.path.join(base, f"{subset}.txt"), raw=True)
    if m["file_format"] == "XY_sparse":
        return read_xy_sparse(spark, os.path.join(base, f"{subset}_X.txt"), os.path.join(base, f"{subset}_Y.txt"))
    return read_json_lines(spark, os.path.join(base, f"{subset}.json"), ["title", "content"], "target_ind")
