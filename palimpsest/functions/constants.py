"""Fixed values of the container format and of the planners."""

#: Marks of a container's parts.  Containers of other writers have the same layout under marks
#: of their own, which readers and writers take as a parameter.
MARKS = {"prefix": b"PLMP\r\n\x1a\x04", "index": b"PLMPIX4\x00", "footer": b"PLMPIDX4", "fine": b"PLMPFV1\x00"}

# Record sizes and the mark of an instruction stream.
OPS_MAGIC = b"V4OPS\r\n\x01"
FORMAT_VERSION = 4
PREFIX_SIZE, FOOTER_SIZE, WINDOW_SIZE = 16, 64, 88
IDENTITY_CHUNK = 8 << 20

# Window kinds and codecs.
KINDS = {"SAME": 1, "COPY": 2, "DELTA_RAW": 3, "DELTA_ZSTD": 4, "REPLACE_RAW": 5, "REPLACE_ZSTD": 6, "ZERO": 7, "RUN": 8}
CODECS = {"none": 0, "zstd": 1}

# Opcodes of an instruction stream.
OPCODES = {
    "END": 0,
    "COPY_SAME_SHORT": 1,
    "COPY_LOCAL_SHORT": 2,
    "COPY_LOCAL_LONG": 3,
    "COPY_DELTA_SHORT": 4,
    "COPY_ABSOLUTE": 5,
    "ADD_SHORT": 6,
    "ADD_LONG": 7,
    "RUN_BYTE": 8,
    "ZERO": 9,
    "COPY_ADD_PAIR": 10,
}

# Limits.
MAX_INDEX = 256 << 20
MAX_FILES = 1 << 18
MAX_WINDOWS = 1 << 24
MAX_PATH = 1 << 20
MAX_COMMENT = 16 << 20
MAX_FINE_PER_FILE = 1 << 22
MAX_FINE_TOTAL = 1 << 19
WINDOW_SIZES = (256 << 10, 512 << 10, 1 << 20, 2 << 20, 4 << 20, 8 << 20)
MODES = ("balanced", "apply-speed", "patch-size")
#: Bands and table penalty of the fine verification planner, by mode.
FINE_BANDS = {"apply-speed": (64 << 10, 256 << 10, 1 << 20), "balanced": (256 << 10, 1 << 20), "patch-size": (1 << 20,)}
FINE_PENALTY = {"apply-speed": 1, "balanced": 4, "patch-size": 16}
FINE_ENTRY_BYTES = 40
FINE_TABLE_BYTES = 16 << 20
