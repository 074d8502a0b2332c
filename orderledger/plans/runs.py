"""The manifests of runs as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.run_history import RUN, run_manifest
from ..sources.documents import ListField, MapField, write_json_documents
from ..sources.shared import stage_table


def write_manifests(results: DataFrame, runs: DataFrame, path: str, parameters: DataFrame | None = None, digits: int = 2) -> str:
    """A document for every row of ``runs``: its columns, the names of its stages in order as
    ``stages_run``, the last outputs of each name as ``outputs``, and its ``parameters``
    (RUN, key, value) if given.

    A run without results has a document whose lists are empty. ``digits`` sets the number of
    folders, see ``write_json_documents``. ``path`` is returned.
    """
    manifest = stage_table(run_manifest(results), "manifest")
    fields: dict[str, ListField | MapField] = {
        "stages_run": ListField(manifest, "name", ("place",)),
        "outputs": MapField(manifest.where("last"), "name", "outputs"),
    }
    if parameters is not None:
        fields["parameters"] = MapField(stage_table(parameters, "parameters"), "key", "value")
    return write_json_documents(stage_table(runs, "runs"), path, RUN, fields, digits)
