"""An archive on disk: index a folder, search it, browse it.

Three keyed tables (``state``, ``chunks``, ``profiles``) live in versions below
one root.  A run writes the next version of each, the state last; what a run
that failed left on the way is taken up by the next, and one that is repeated
finds nothing to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill import registry
from leafmill.config import Config
from leafmill.functions import keywords, profile, quality, splitting
from leafmill.operators import answers, index, parsing, retrieval, sections
from leafmill.operators.filters import Filters, chunk_predicate, profile_predicate
from leafmill.scratch import Scratch

SCHEMAS = {
    "state": "document_id string, path string, content_hash string, status string, error string, chunk_count int",
    "chunks": "chunk_id string, document_id string, text string, page_no int, section_title string, section_path string, start int, end int, "
    "language string, job_id string, dense array<double>",
    "profiles": "document_id string, path string, filename string, doc_type string, language string, modified_at timestamp, size long, page_count int, "
    "summary string, topics array<string>, entities array<string>, parse_quality double, parser_used string, content_hash string, job_id string, "
    "profile_text string, dense array<double>",
    "meta": "fingerprint string",
}


class Archive:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        e = self.config.embedding
        self.embed = registry.build("embedder", e.provider, dim=e.dim, normalize=e.normalize, base_url=e.base_url, model=e.model, api_key=e.api_key)
        self.fingerprint = index.fingerprint(e.provider, e.model, e.dim, e.normalize, False)
        stored = self.read("meta").first()
        index.check_fingerprint(stored and stored.fingerprint, self.fingerprint)

    # --- versions -----------------------------------------------------------

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(
            int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if fs.exists(done(s.getPath(), "_SUCCESS"))
        )

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/v{versions[-1]}")

    def _write(self, name: str, rows: DataFrame) -> DataFrame:
        version = (self._versions(name) or [0])[-1] + 1
        columns = [F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], SCHEMAS[name]).schema]
        rows.select(*columns).write.parquet(f"{self.root}/{name}/v{version}")
        return self.read(name)

    # --- writing ------------------------------------------------------------

    def index(self, folder: str, job_id: str | None = None, retry_failed: bool = False) -> dict[str, int]:
        """New and changed files of a folder, and those that an earlier run left
        on the way; returns the progress counts.  The three tables change one
        after the other, the state last: a run that fails in between is made up
        for by the next, which finds its files pending and replaces what they
        left."""
        found = index.discover(self.spark, folder)
        state = self.read("state")
        work = index.to_do(found, state, retry_failed)
        left = index.stranded(state, folder).select("document_id")
        work = work.unionByName(found.join(left, "document_id", "left_semi").join(work.select("document_id"), "document_id", "left_anti"))
        if not work.isEmpty():
            self._write("state", index.begin(state, work))
            scratch = Scratch(self.spark, "parsed")
            parsed = scratch.keep(work.drop("content").join(parsing.parse(work, scratch, self.config.quality), "path"), "files")
            self._store(parsed, job_id)
            scratch.drop()
            if not self._versions("meta"):
                self._write("meta", self.spark.createDataFrame([(self.fingerprint,)], SCHEMAS["meta"]))
        return index.progress(self.read("state")).first().asDict()

    def _store(self, parsed: DataFrame, job_id: str | None) -> None:
        good = parsed.where("status <> 'failed'")
        blocks = good.select("document_id", F.explode("blocks").alias("b")).select("document_id", "b.*")
        outline = good.select("document_id", F.explode("outline").alias("o")).select("document_id", "o.*", F.lit(None).cast("int").alias("page_no"))
        sectioned = sections.sectioned(blocks.drop("level").withColumnRenamed("ix", "block_ix"), outline)
        c = self.config.chunking
        chunks = splitting.chunk_documents(
            sectioned.select("document_id", "block_ix", "text", "page_no", "kind", "level", "title", "path", "gap"), c.target_chars, c.overlap_ratio
        )
        job = F.lit(job_id).cast("string")
        chunks = chunks.withColumns({"language": quality.detect_language(F.col("text")), "job_id": job, "dense": self.embed(F.col("text"))})
        # Documents that changed leave no chunks behind.
        self._write("chunks", self.read("chunks").join(parsed.select("document_id"), "document_id", "left_anti").unionByName(chunks))
        self._write("profiles", index.replace_documents(self.read("profiles"), self._profiles(good, job)))
        counts = self.read("chunks").groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        done = parsed.select("document_id", F.when(F.col("status") != "failed", "profiled").otherwise("failed").alias("status"), "error").join(counts, "document_id", "left")
        self._write("state", index.transition(self.read("state"), done))

    def _profiles(self, good: DataFrame, job) -> DataFrame:
        whole = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
        texts = F.transform(F.filter("blocks", lambda b: b["kind"] == "text"), lambda b: b["text"])
        terms = keywords.extract(good.select("document_id", whole.alias("text")))
        rows = good.join(terms, "document_id").withColumns({"whole": whole, "intro": profile.intro(texts), "filename": F.element_at(F.split("path", "/"), -1)})
        body = F.col("whole")
        outline = profile.outline_text(F.col("outline"))
        rows = rows.withColumns(
            {
                "doc_type": F.lower(F.element_at(F.split("filename", r"\."), -1)),
                "language": quality.detect_language(body),
                "entities": F.slice(profile.entities_by_place(body), 1, 15),
                "parse_quality": F.col("quality"),
                "summary": F.substring("intro", 1, 300),
                "topics": F.slice("keywords", 1, 10),
                "parser_used": F.col("parser"),
                "job_id": job,
            }
        )
        title = profile.title(F.lit(None).cast("string"), F.get(F.col("outline"), F.lit(0))["title"], F.lit(None).cast("string"))
        text = profile.profile_text(
            title, profile.path_terms(F.col("path")), outline, F.col("keywords"), F.col("intro"), F.col("entities"), F.col("doc_type"), F.col("page_count")
        )
        rows = rows.withColumn("profile_text", text)
        return rows.withColumn("dense", self.embed(F.col("profile_text"))).select(*[f.split()[0] for f in SCHEMAS["profiles"].split(", ")])

    def promote(self, document_id: str, job_id: str | None = None) -> None:
        """Gives a document to a job, or to everyone."""
        for name in ("chunks", "profiles"):
            self._write(name, index.set_job(self.read(name), F.lit(document_id), job_id))

    def drop_all(self) -> None:
        """Removes all tables; the next run begins anew, with any embedding."""
        for name in SCHEMAS:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # --- reading ------------------------------------------------------------

    def profile(self, document_id: str):
        """The profile row of a document, or None."""
        return self.read("profiles").where(F.col("document_id") == document_id).first()

    def _question(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(1, text)], "query_id int, query string")

    def search(self, text: str, strategy: str | None = None, k: int | None = None, filters: Filters | None = None, doc_ids=None, rerank: str | None = None) -> DataFrame:
        """Ranked chunks with their text, place and document."""
        r = self.config.retrieval
        k, filters = k or r.chunk_k, filters or Filters()
        chunks = self.read("chunks")
        asked = self._question(text)
        vector = asked.select("query_id", self.embed(F.col("query")).alias("vector"))
        lexical = {"text": retrieval.text_membership, "bm25": retrieval.bm25, "sparse": retrieval.sparse_terms}
        hits = retrieval.search(
            strategy or r.strategy,
            lambda n: retrieval.search_chunks(vector, chunks, n, filters, doc_ids),
            lambda n: lexical[r.keyword_backend](asked, chunks, n, filters, doc_ids),
            k,
            registry.build("reranker", rerank) if rerank else None,
            r.rerank_candidates,
        )
        rows = hits.drop("query_id").join(chunks.drop("dense"), "chunk_id")
        if r.neighbour_width > 0:
            wide = retrieval.expand_neighbours(hits.select("query_id", "chunk_id", "rank"), chunks, r.neighbour_width)
            rows = rows.drop("text").join(wide.select("chunk_id", "text"), "chunk_id")
        return retrieval.display_names(rows, self.read("profiles")).orderBy("rank")

    def search_documents(self, text: str, k: int = 10, filters: Filters | None = None) -> DataFrame:
        vector = self._question(text).select("query_id", self.embed(F.col("query")).alias("vector"))
        hits = retrieval.search_profiles(vector, self.read("profiles"), k, filters).drop("query_id")
        return hits.join(self.read("profiles").drop("dense", "profile_text"), "document_id").orderBy("rank")

    def list_documents(self, filters: Filters | None = None, limit: int = 50) -> DataFrame:
        rows = self.read("profiles").where(profile_predicate(filters or Filters()))
        return answers.listing(rows, limit).select("document_id", "filename", "doc_type", "language", "page_count", "topics", "summary", "job_id")

    def document(self, document_id: str, section: str | None = None, job: str | None = None) -> DataFrame:
        return answers.document_text(self.read("chunks").where(F.col("document_id") == document_id), section, job)

    def outline(self, document_id: str, job: str | None = None) -> DataFrame:
        scope = F.col("job_id").isNull() if job is None else F.col("job_id") == job
        return answers.document_outline(self.read("chunks").where((F.col("document_id") == document_id) & scope))

    def context(self, chunk_id: str, before: int = 500, after: int = 500) -> DataFrame:
        hit = self.spark.createDataFrame([(chunk_id,)], "chunk_id string")
        return retrieval.expand_context(hit, self.read("chunks"), before, after)

    def visible(self, filters: Filters) -> DataFrame:
        by = Window.partitionBy("document_id").orderBy("start")
        return self.read("chunks").where(chunk_predicate(filters)).withColumn("pos", F.row_number().over(by))
