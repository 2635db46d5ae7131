"""A project: named layers, changed in drafts that are published whole or not at all.

Layers are immutable, so a draft is a copy of the names and costs nothing.
"""

from __future__ import annotations

import builtins
import json
import os
from dataclasses import asdict, replace

from pyspark.sql import functions as F

from .functions import geometry
from .model import FID, GEOM, Field, Layer, LayerError, LayerMeta
from .operators import combine, display, select
from .sources import catalog


class Project:
    def __init__(self, name: str, crs: str = ""):
        self.name, self.crs = name, crs
        self._layers: dict[str, Layer] = {}
        self._draft: dict[str, Layer] | None = None

    def begin(self) -> None:
        if self._draft is not None:
            raise LayerError("a draft is open")
        self._draft = dict(self._layers)

    def commit(self) -> None:
        self._layers, self._draft = self._open(), None

    def rollback(self) -> None:
        self._open()
        self._draft = None

    def _open(self) -> dict[str, Layer]:
        if self._draft is None:
            raise LayerError("no draft is open")
        return self._draft

    def __enter__(self) -> Project:
        self.begin()
        return self

    def __exit__(self, kind, *_) -> None:
        self.commit() if kind is None else self.rollback()

    def names(self) -> list[str]:
        return list(self._layers)

    def layer(self, name: str) -> Layer:
        found = (self._draft if self._draft is not None else self._layers).get(name)
        if found is None:
            raise LayerError(f"no such layer: {name}")
        return found

    def add(self, lay: Layer) -> None:
        draft = self._open()
        if lay.meta.name in draft:
            raise LayerError(f"layer exists: {lay.meta.name}")
        draft[lay.meta.name] = lay

    def publish(self, lay: Layer) -> None:
        """One layer in a draft of its own."""
        with self:
            self.add(lay)

    def remove(self, name: str) -> None:
        self.layer(name)
        del self._open()[name]

    def rename(self, name: str, display: str) -> None:
        if any(n != name and (x.meta.display_name or n).lower() == display.strip().lower() for n, x in self._open().items()):
            raise LayerError(f"name in use: {display}")
        self._open()[name] = replace(self.layer(name), meta=replace(self.layer(name).meta, display_name=display.strip()))

    def lock_geometry(self, name: str, locked: bool = True) -> None:
        self._open()[name] = replace(self.layer(name), meta=replace(self.layer(name).meta, geometry_locked=locked))

    def _editable(self, name: str, shape: bool = False) -> Layer:
        lay = self.layer(name)
        if not lay.meta.editable or (shape and lay.meta.geometry_locked):
            raise LayerError(f"layer is locked: {name}")
        return lay

    def _has(self, lay: Layer, fid: int) -> bool:
        return bool(lay.df.where(F.col(FID) == fid).limit(1).count())

    def add_feature(self, name: str, row: dict) -> None:
        lay = self._editable(name)
        if self._has(lay, row[FID]):
            raise LayerError(f"feature exists: {row[FID]}")
        new = lay.df.sparkSession.createDataFrame([tuple(row.get(c) for c in lay.df.columns)], lay.df.schema)
        self._open()[name] = lay.with_df(lay.df.unionByName(new))

    def delete_feature(self, name: str, fid: int) -> None:
        lay = self._editable(name)
        if not self._has(lay, fid):
            raise LayerError(f"no such feature: {fid}")
        self._open()[name] = lay.with_df(lay.df.where(F.col(FID) != fid))

    def set_property(self, name: str, fid: int, field: str, value) -> None:
        lay = self._editable(name)
        lay.require(field)
        if not self._has(lay, fid):
            raise LayerError(f"no such feature: {fid}")
        kind = lay.df.schema[field].dataType
        column = F.when(F.col(FID) == fid, F.lit(value).cast(kind)).otherwise(F.col(f"`{field}`"))
        self._open()[name] = lay.with_df(lay.df.withColumn(field, column))

    def set_geometry(self, name: str, fid: int, wkb: bytes) -> None:
        lay = self._editable(name, shape=True)
        if not self._has(lay, fid):
            raise LayerError(f"no such feature: {fid}")
        self._open()[name] = lay.with_df(lay.df.withColumn(GEOM, F.when(F.col(FID) == fid, F.lit(bytearray(wkb))).otherwise(F.col(GEOM))))

    def move_vertex(self, name: str, fid: int, index: int, x: float, y: float) -> None:
        lay = self._editable(name, shape=True)
        moved = geometry.move_vertex(index, x, y)(F.col(GEOM))
        self._open()[name] = lay.with_df(lay.df.withColumn(GEOM, F.when(F.col(FID) == fid, moved).otherwise(F.col(GEOM))))

    def save(self, path: str) -> None:
        """The project without its data, as versioned JSON with paths relative to the file, replaced whole."""
        folder = os.path.dirname(os.path.abspath(path))
        layers = []
        for lay in self._layers.values():
            meta = asdict(lay.meta)
            if meta["source"] and not meta["source"].count("://"):
                meta["source"] = os.path.relpath(meta["source"], folder)
            layers.append(meta)
        with builtins.open(f"{path}.new", "w", encoding="utf-8") as out:
            json.dump({"version": 1, "name": self.name, "crs": self.crs, "layers": layers}, out, ensure_ascii=False, indent=1)
        os.replace(f"{path}.new", path)

    def filter(self, name: str, rule: str, made: str) -> None:
        """The features for which a rule is true, as a further layer, in a draft of its own."""
        found = select.filter_rule(self.layer(name), rule)
        self.publish(found.with_df(found.df, name=made, source=""))

    def merge(self, names: list[str], made: str) -> None:
        """Several layers as one, the ids of each after the last one's."""
        found = combine.append([self.layer(n) for n in names])
        self.publish(found.with_df(found.df, name=made, source=""))

    def label(self, name: str, rule: str | None, text: str, rotation: str | None = None) -> None:
        """A layer's labels composed anew; the layer stays as it was if that fails."""
        with self:
            self._open()[name] = display.label_rule(self._editable(name), rule, text, rotation)

    def visible(self) -> list[Layer]:
        """The layers that are shown, in the order in which they are drawn."""
        return [lay for lay in self._layers.values() if lay.meta.visible]

    def show(self, name: str, visible: bool = True) -> None:
        self._open()[name] = replace(self.layer(name), meta=replace(self.layer(name).meta, visible=visible))

    def reorder(self, names: list[str]) -> None:
        """The order of drawing; every layer must be named once."""
        draft = self._open()
        if sorted(names) != sorted(draft):
            raise LayerError("an order names every layer once")
        self._draft = {n: draft[n] for n in names}

    def tree(self) -> list[dict]:
        """Name, shown name, CRS and flags of each layer."""
        shown = lambda m: {"name": m.name, "shown": m.display_name or m.name, "crs": m.crs, "visible": m.visible, "editable": m.editable, "locked": m.geometry_locked}
        return [shown(lay.meta) for lay in self._layers.values()]

    def save_layer(self, name: str, path: str) -> None:
        """The layer written to a source, which it then names as its own."""
        lay = self.layer(name)
        catalog.save_layer(lay, path)
        self._layers[name] = replace(lay, meta=replace(lay.meta, source=path))

    def save_all(self, path: str) -> None:
        """Every layer that no source holds as a table beside the project, then the project."""
        stem = os.path.splitext(path)[0]
        for i, name in enumerate(self._layers):
            if not self._layers[name].meta.source:
                self.save_layer(name, f"{stem}_{i + 1}.parquet")
        self.save(path)

    @staticmethod
    def open(spark, path: str) -> Project:
        """The project with its layers, read from their sources."""
        name, crs, metas = Project.load(path)
        project = Project(name, crs)
        for meta in metas:
            if not meta.source:
                raise LayerError(f"layer without a source: {meta.name}")
            project._layers[meta.name] = Layer(catalog.open_layer(spark, meta.source, meta.name, meta.crs).df, meta)
        return project

    @staticmethod
    def load(path: str) -> tuple[str, str, list[LayerMeta]]:
        with builtins.open(path, encoding="utf-8") as file:
            document = json.load(file)
        if document.get("version") != 1:
            raise LayerError("unknown project version")
        folder = os.path.dirname(os.path.abspath(path))
        metas = []
        for m in document["layers"]:
            source = m.pop("source")
            if source and "://" not in source:
                source = os.path.normpath(os.path.join(folder, source))
            metas.append(LayerMeta(**m | {"fields": tuple(Field(**f) for f in m["fields"]), "source": source}))
        return document["name"], document["crs"], metas
