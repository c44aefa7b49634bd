"""Calls on one loaded document: statistics, search, lookup, pages, trees, folders, files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import Document
from .functions import scalars as fn
from .operators import explore, files, listing, profile
from .operators.bundle import Bundle
from .operators.search_index import SearchIndex
from .tables import settle

#: Above this many components a tree is a flat page.
TREE_MOST = 5000


@dataclass(frozen=True)
class Explorer:
    document: Document

    @property
    def _spark(self):
        return self.document.components.sparkSession

    @cached_property
    def index(self) -> SearchIndex:
        return SearchIndex.build(self.document.components)

    @cached_property
    def graph(self) -> Bundle:
        return Bundle.build({"": (self.document.components, self.document.edges)})

    @cached_property
    def catalogue(self) -> DataFrame:
        """Listed files, and locations of components that are not among them."""
        return settle(files.catalogue(self.document.files.drop("sbom_id"), self.document.components), "catalogue")

    @cached_property
    def owners(self) -> DataFrame:
        return settle(files.owners(self.catalogue, self.document.components, self.document.relations), "owners")

    @cached_property
    def folders(self) -> DataFrame:
        return settle(files.directory_index(self.catalogue), "folders")

    @cached_property
    def dependencies(self) -> DataFrame:
        """id, dependencies: ids in adjacency order."""
        ordered = F.array_sort(F.collect_list(F.struct("adj_ordinal", "dst_id")))
        return settle(self.document.edges.groupBy(F.col("src_id").alias("id")).agg(ordered.alias("d")).select("id", F.col("d.dst_id").alias("dependencies")), "dependencies")

    def statistics(self) -> dict[str, DataFrame | dict]:
        """One row of counts and coverage, types, licences, and the facts with relation counts."""
        c = self.document.components
        counts = profile.profile(c).crossJoin(profile.dependency_counts(self.document.dependencies)).crossJoin(self.catalogue.agg(F.count("*").alias("files_count")))  # one row each
        share = lambda have: F.when(F.col("total") > 0, have / F.col("total") * 100)
        counts = counts.withColumns({"cpe_percent": share(F.col("with_cpes")), "purl_percent": share(F.col("with_purl")), "license_percent": share(F.col("total") - F.col("without_license")), "hash_percent": share(F.col("with_hashes"))})
        return {"counts": counts, "types": profile.by_type(c), "licenses": profile.by_license(c), "facts": self.document.facts}

    def search(self, query: str) -> DataFrame:
        return self.index.search(self._spark, query).select("id", "name", "version", "purl", fn.pkg_type(F.col("purl")).alias("type"), "licenses", "supplier")

    def component(self, id_: str) -> DataFrame:
        """The last component with this id, with its dependencies and the number of its files."""
        found = self.index.lookup(self._spark, id_)
        own = self.owners.groupBy("ordinal").agg(F.count("*").alias("files"))
        rows = found.join(self.dependencies, "id", "left").join(own, "ordinal", "left")
        return rows.select("id", "name", "version", "purl", fn.pkg_type(F.col("purl")).alias("type"), "licenses", "hashes", F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"), "supplier", "raw", F.coalesce("files", F.lit(0)).alias("files"))

    def tree(self, offset: int = 0, limit: int = 200) -> DataFrame:
        """Nested trees of all roots; for large documents a page of components with their dependencies."""
        if self.document.components.count() <= TREE_MOST:
            return self.graph.tree("", self.document.components).orderBy("root_at", "page")
        page = self.index.page(self._spark, offset, limit).join(self.dependencies, "id", "left")
        listed = F.coalesce("dependencies", F.array().cast("array<string>"))
        return page.orderBy("position").select("id", "name", "version", fn.pkg_type(F.col("purl")).alias("type"), (F.size(listed) > 0).alias("has_children"), listed.alias("children_ids"))

    def listing(self, pattern: str = "") -> DataFrame:
        """title, description of all rows, or of those that match the pattern, best first."""
        c = self.document.components.join(self.dependencies, "id", "left")
        texts = [listing.title(F.col("name"), F.col("version")).alias("title"), listing.description(F.col("purl"), F.col("licenses"), F.size(F.coalesce("dependencies", F.array()))).alias("description")]
        if not pattern:
            return c.orderBy("ordinal").select("ordinal", *texts)
        return c.join(listing.ranked(self.document.components, pattern), "ordinal").orderBy(F.desc("score"), "ordinal").select("ordinal", *texts, "score")

    def browse(self, path: str = "/", query: str = "", layer: str = "", component: str = "", offset: int = 0, limit: int = 100) -> tuple[DataFrame, int]:
        """A page of entries and how many there are: those of a folder, or the files that match a query
        (a glob, else a part of path, type and mime), a layer and a component, ordered by path."""
        if not (query or layer or component):
            entries = files.directory_page(self.folders, path or "/", offset, limit)
            facts = self.catalogue.groupBy("path").agg(*[F.first(c).alias(c) for c in ("file_type", "mime", "size", "mode")])
            total = self.folders.where(F.col("folder") == (path or "/")).count()
            return entries.join(facts, "path", "left").orderBy("position").select("name", "path", "is_dir", "children", *[F.when(~F.col("is_dir"), F.col(c)).alias(c) for c in ("file_type", "mime", "size", "mode")]), total
        found = self.catalogue
        if component:
            ordinal = self.index.lookup(self._spark, component).select("ordinal")
            found = found.join(self.owners.join(ordinal, "ordinal", "left_semi").select("path"), "path", "left_semi")
        if layer:
            found = found.where(F.col("layer") == layer)
        if query:
            found = explore.filter_files(found, query)
        rows = settle(found.select(F.substring_index("path", "/", -1).alias("name"), "path", F.lit(False).alias("is_dir"), F.lit(0).alias("children"), "file_type", "mime", "size", "mode"), "matches")
        return rows.orderBy("path").offset(offset).limit(limit), rows.count()

    def file(self, path: str) -> tuple[DataFrame, DataFrame]:
        """The file, and its components with their first relation to it, in document order."""
        related = self.owners.where(F.col("path") == path).join(self.document.components, "ordinal")
        rank = F.array_position(F.array(*map(F.lit, files.RELATIONS)), F.col("relation"))
        return self.catalogue.where(F.col("path") == path), related.orderBy(rank, "ordinal").select("id", "name", "version", "type", "relation", "licenses")

    def file_statistics(self) -> DataFrame:
        return files.statistics(self.catalogue, self.document.components, self.document.relations)

    def layers(self) -> DataFrame:
        return files.layers(self.catalogue).orderBy("first_path")
