"""The repository's tools as one Python object; every call is scoped to an owner and answers with plain dictionaries."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.ids import stable_uuid
from folioforge.operators import folders, repository, retrieval
from folioforge.sources.detect import MAX_TOOL_BYTES, owned_path, validate_uploads


#: Rows of the largest page.
MAX_PAGE = 1000


class NotAllowed(PermissionError):
    """The client has no right to write."""


class Repository:
    """tables: documents, document_versions, document_chunks, folders, document_ingestion_jobs, client_permissions.

    search(query, scope or None, k) -> hits is the search that the tool uses; lexical search by default.
    """

    def __init__(self, tables: Mapping[str, DataFrame], owner_id: str, client_id: str = "", search: Callable[[str, DataFrame | None, int], DataFrame] | None = None) -> None:
        self.tables = {name: repository.owned(df, owner_id) for name, df in tables.items()}
        self.owner_id, self.client_id, self._search = owner_id, client_id, search or self._lexical

    @staticmethod
    def _rows(df: DataFrame) -> list[dict]:
        """The rows of an answer, which is a page, a top-k or one row."""
        return [json.loads(x) for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toPandas()["j"]]

    def _page(self, df: DataFrame, order: list[str], page: int, size: int) -> list[dict]:
        if page < 1 or not 1 <= size <= MAX_PAGE:
            raise ValueError(f"pages start at 1 and have 1 to {MAX_PAGE} rows")
        return self._rows(df.orderBy(*order).offset((page - 1) * size).limit(size))

    def _active(self) -> DataFrame:
        return self.tables["documents"].where("coalesce(deletion_status, 'active') = 'active'")

    def _lexical(self, query: str, scope: DataFrame | None, k: int) -> DataFrame:
        current = self._active().select("document_id", "title", F.col("latest_version_id").alias("version_id"))
        rows = self.tables["document_chunks"].drop("title").join(current, ["document_id", "version_id"])
        if scope is not None:
            rows = rows.join(scope, "document_id", "left_semi")
        return retrieval.lexical_search(rows, query, k)

    def search_repository(self, query: str, folder_id: str | None = None, document_ids: list[str] | None = None, top_k: int | None = None) -> dict:
        asked = retrieval.parse_search_request(query, document_ids, folder_id, retrieval.clamp_top_k(top_k))
        wanted = None
        if asked["document_ids"] is not None:
            wanted = self._active().where(F.col("document_id").isin(asked["document_ids"])).select("document_id")
        scope = None
        if folder_id is not None or wanted is not None:
            scope = folders.search_scope(self._active(), self.tables["folders"], folder_id, wanted)
        return {"query": asked["query"], "results": self._rows(self._search(asked["query"], scope, asked["top_k"]))}

    def list_folders(self, page: int = 1, size: int = 1000) -> dict:
        return {"folders": self._page(self.tables["folders"], ["sort_order", "name", "id"], page, size)}

    def list_documents(self, folder_id: str | None = None, page: int = 1, size: int = 1000) -> dict:
        rows = folders.documents_in_scope(self._active(), self.tables["folders"], folder_id, recursive=False)
        return {"folder_id": folder_id, "documents": self._page(rows, ["sort_order", "title", "document_id"], page, size)}

    def get_document(self, document_id: str) -> dict:
        chunks = self.tables["document_chunks"]
        got = self._rows(repository.document_outline(self.tables["documents"], self.tables["document_versions"], chunks, document_id))
        return {"document": got[0] if got else None}

    def get_chunk(self, chunk_id: str) -> dict:
        got = self._rows(repository.lookup(self.tables["document_chunks"].join(self._active().select("document_id"), "document_id", "left_semi"), "chunk_id", chunk_id))
        return {"chunk": got[0] if got else None}

    def get_original(self, document_id: str) -> dict:
        """The storage path of the current original, if it is where this owner's files belong."""
        rows = self._active().where(F.col("document_id") == document_id).join(self.tables["document_versions"].select(F.col("version_id").alias("latest_version_id"), "storage_path", "original_filename"), "latest_version_id")
        got = self._rows(rows.where(owned_path(F.col("storage_path"), F.lit(self.owner_id), F.col("document_id"), F.col("latest_version_id"))).select("document_id", "storage_path", "original_filename"))
        return {"original": got[0] if got else None}

    def _check_writer(self) -> None:
        if self.client_id:
            allowed = self.tables["client_permissions"].where((F.col("client_id") == self.client_id) & F.col("can_upload"))
            if allowed.isEmpty():
                raise NotAllowed("this client may not upload")

    def create_upload(self, name: str, mime_type: str, size_bytes: int, folder_id: str | None = None, nonce: str = "") -> dict:
        """The rows of a new document, its version and its job, with ids made from name and nonce; writing them is the caller's."""
        self._check_writer()
        spark = self.tables["documents"].sparkSession
        given = spark.range(1).select(F.lit(name).alias("name"), F.lit(mime_type).alias("mime_type"), F.lit(size_bytes).cast("long").alias("size_bytes"))
        made = lambda kind: stable_uuid(F.concat_ws(":", F.lit(kind), F.lit(self.owner_id), "name", F.lit(nonce)))
        row = self._rows(validate_uploads(given, MAX_TOOL_BYTES).select("*", made("document").alias("document_id"), made("version").alias("version_id"), made("job").alias("job_id")))[0]
        if row["reason"]:
            raise ValueError(f"the upload is refused: {row['reason']}")
        if folder_id is not None and self.tables["folders"].where(F.col("id") == folder_id).isEmpty():
            raise ValueError("the folder does not exist")
        path = f"{self.owner_id}/{row['document_id']}/{row['version_id']}/original"
        return {"upload": row | {"folder_id": folder_id, "storage_path": path, "status": "uploading"}}

    def get_ingestion_status(self, job_id: str) -> dict:
        got = self._rows(repository.stored_job(repository.lookup(self.tables["document_ingestion_jobs"], "job_id", job_id)))
        return {"ingestion": got[0] if got else None}

    def complete_upload(self, document_id: str, version_id: str, job_id: str) -> dict:
        """The event that hands an upload to processing; asking twice makes no second one."""
        self._check_writer()
        found = self.tables["document_ingestion_jobs"].where((F.col("job_id") == job_id) & (F.col("document_id") == document_id) & (F.col("version_id") == version_id))
        rows = self._rows(repository.stored_job(found))
        if not rows:
            raise ValueError("the upload does not exist")
        fresh = rows[0]["status"] == "uploading"
        return {"processing": {"job_id": job_id, "started": fresh, "event": {"kind": "claim", "token": f"run:{job_id}"} if fresh else None}}
