"""Schemas, value sets and constants of the corpus model."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("start_line", T.LongType()),
        T.StructField("end_line", T.LongType()),
        T.StructField("token_count", T.LongType()),
    ]
)
FILES = "data_source_id string, file_path string, content string, size long"
CHUNKS = "chunk_id string, data_source_id string, file_path string, ordinal long, content string, start_line long, end_line long, token_count long"
EMBEDDINGS = "chunk_id string, embedding array<float>"
SOURCES = (
    "id string, repo_url string, owner string, repo string, branch string, type string, description string, include_patterns array<string>, "
    "exclude_patterns array<string>, sync_schedule string, last_synced_at timestamp, last_sync_commit_sha string, status string, error_message string"
)
RUNS = "id string, data_source_id string, run_key string, commit_sha string, status string, total_files long, fetch_strategy string, started_at timestamp, completed_at timestamp"
RUN_FILES = "run_id string, file_path string, file_sha string, file_size long, status string, chunk_count long, token_count long, error_message string, updated_at timestamp"

MAX_FILE_BYTES = 1_000_000
MANY_FILES = 10_000

# Names that tell the kind of a search result.
WORKFLOW_DIRECTORY = ".github/workflows/"
ACTION_NAMES = ["action.yml", "action.yaml"]
#: Names and patterns, in lower case, of the markers of a file.
TEST_DIRECTORIES, TEST_NAME = "/(test|tests|spec|__tests__)/", r"\.(test|spec)\."
DOC_NAME, DOC_DIRECTORIES = r"\.mdx?$", "/(docs|wiki)/"
WORKFLOW_PATH = r"(^|/)\.github/workflows/"
ACTION_FILES = ["action.yml", "action.yaml"]
CONFIG_NAMES = [
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "tsconfig.json", "jsconfig.json",
    ".gitignore", ".npmignore", ".eslintignore", ".prettierignore", "dockerfile",
]
CONFIG_PATTERNS = [r"\.config\.[^/]+$", r"\.(eslintrc|prettierrc|babelrc)", r"\.env(\.|$)", r"(vite|webpack|jest|vitest|rollup)\.config\."]
CONFIG_HEADS = ["package.json", "tsconfig.json", "eslint.config", ".eslintrc", ".prettierrc"]

# They must equal those of the indexed data's conventions.
BINARY_EXTENSIONS = (
    "png jpg jpeg gif ico bmp webp svg woff woff2 ttf eot otf zip tar gz bz2 xz 7z rar pdf doc docx xls xlsx ppt pptx "
    "exe dll so dylib o a lib wasm pyc class jar mp3 mp4 avi mov wav flac sqlite db"
).split()
#: What the fetch tool refuses: another list.
TOOL_BINARY_EXTENSIONS = (
    "png jpg jpeg gif webp ico bmp svg wasm zip tar gz bz2 xz 7z rar exe dll so dylib bin obj o a lib pdf doc docx xls xlsx ppt pptx "
    "mp3 mp4 wav ogg avi mov mkv ttf woff woff2 eot otf lock"
).split()
DEFAULT_EXCLUDES = [
    "**/node_modules/**",
    "**/dist/**",
    "**/build/**",
    "**/.git/**",
    "**/package-lock.json",
    "**/yarn.lock",
    "**/pnpm-lock.yaml",
    "**/*.min.js",
    "**/*.map",
    "**/*.png",
    "**/*.jpg",
    "**/*.gif",
    "**/*.ico",
    "**/*.woff",
    "**/*.woff2",
    "**/*.ttf",
    "**/*.eot",
]
PRESETS = {
    "general": [],
    "documentation": ["**/*.md", "**/*.mdx", "docs/**", "wiki/**"],
    "source-code": ["**/*.{ts,tsx,js,jsx,mjs,cjs,py,go,java,cs,rs,rb,md,mdx}"],
    "github-actions-library": ["**/action.yml", "**/action.yaml", "**/README.md"],
    "cicd-workflows": [".github/workflows/**", "**/README.md"],
    "openapi-specs": ["**/*.yaml", "**/*.yml", "**/*.json", "openapi/**", "swagger/**", "**/README.md"],
}
LANGUAGES = {
    "ts": "typescript",
    "mts": "typescript",
    "cts": "typescript",
    "tsx": "tsx",
    "js": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "jsx": "javascript",
    "py": "python",
    "go": "go",
    "java": "java",
    "cs": "csharp",
    "rs": "rust",
    "rb": "ruby",
}
SHORT_LANGUAGE = {"typescript": "ts", "tsx": "tsx", "javascript": "js", "python": "py", "go": "go", "java": "java", "csharp": "cs", "rust": "rs", "ruby": "rb"}
FENCES = {
    "ts": "ts", "tsx": "tsx", "js": "js", "jsx": "jsx", "mjs": "js", "cjs": "js", "py": "py", "rb": "rb", "go": "go", "rs": "rs",
    "java": "java", "kt": "kt", "cs": "cs", "cpp": "cpp", "c": "c", "h": "h", "json": "json", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "md": "md", "html": "html", "css": "css", "scss": "scss", "sh": "sh", "bash": "sh", "zsh": "sh", "sql": "sql", "graphql": "graphql",
}
MODEL_WIDTHS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}
PRICE_PER_MILLION = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "text-embedding-ada-002": 0.10}


@dataclass(frozen=True)
class Tuning:
    """Parameters of hybrid search."""

    rrf_k: int = 60
    over_fetch: int = 3
    path_weight: float = 0.15
    fts_path_weight: float = 5.0
    fts_content_weight: float = 1.0


@dataclass(frozen=True)
class ChunkLimits:
    max_tokens: int = 512
    overlap_tokens: int = 64
    max_input_tokens: int = 8000


@dataclass(frozen=True)
class Settings:
    """Of an engine. ``limits`` change how files are cut and are part of an index's fingerprint; ``top_k`` is not."""

    provider: str = "hash"
    model: str = "text-embedding-3-small"
    dimensions: int = 64
    top_k: int = 10
    limits: ChunkLimits = ChunkLimits()

    def cut_key(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self.limits), sort_keys=True).encode()).hexdigest()
