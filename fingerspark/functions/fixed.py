"""Fixed values of the telemetry data model (names, sets, thresholds).

These must hold exactly as written for results to be right; everything else in
the package is derived from them.
"""

# Behavioural feature schema, in vector order.
FEATURE_SCHEMA_VERSION = "1.0"
FEATURE_NAMES = (
    "syscall_read_freq",
    "syscall_write_freq",
    "syscall_open_freq",
    "syscall_close_freq",
    "syscall_exec_freq",
    "syscall_connect_freq",
    "syscall_accept_freq",
    "syscall_mmap_freq",
    "unique_process_count",
    "unique_syscall_count",
    "process_creation_rate",
    "unique_dest_ips",
    "unique_dest_ports",
    "network_event_ratio",
    "syscall_entropy",
    "process_entropy",
    "privileged_event_ratio",
    "uid_zero_ratio",
)
FEATURE_COUNT = len(FEATURE_NAMES)

# Syscalls whose share of a window is a feature of its own.
FREQUENCY_SYSCALLS = {
    "syscall_read_freq": "read",
    "syscall_write_freq": "write",
    "syscall_open_freq": "open",
    "syscall_close_freq": "close",
    "syscall_exec_freq": "execve",
    "syscall_connect_freq": "connect",
    "syscall_accept_freq": "accept",
    "syscall_mmap_freq": "mmap",
}

# Syscalls that create a process, for process_creation_rate.
PROCESS_CREATING_SYSCALLS = ("execve", "clone", "fork")

# Syscall categories.
CATEGORY_SYSCALLS = {
    "FILE_IO": (
        "read", "write", "open", "openat", "close", "stat", "fstat", "lstat", "lseek",
        "pread64", "pwrite64", "readv", "writev", "access", "rename", "mkdir", "rmdir",
        "unlink", "chmod", "chown",
    ),
    "NETWORK": (
        "socket", "connect", "accept", "accept4", "bind", "listen", "sendto", "recvfrom",
        "sendmsg", "recvmsg", "shutdown", "getsockname", "getpeername", "setsockopt",
        "getsockopt",
    ),
    "PROCESS": (
        "execve", "execveat", "clone", "clone3", "fork", "vfork", "wait4", "waitid", "kill",
        "exit", "exit_group", "getpid", "getppid", "setuid", "setgid", "prctl",
    ),
    "MEMORY": ("mmap", "munmap", "mprotect", "brk", "madvise", "mlock", "munlock", "mremap"),
    "IPC": (
        "pipe", "pipe2", "eventfd", "eventfd2", "signalfd", "timerfd_create",
        "epoll_create", "epoll_ctl", "epoll_wait",
    ),
    "SECURITY": (
        "ptrace", "mount", "umount2", "chroot", "capget", "capset", "seccomp", "bpf",
        "perf_event_open",
    ),
}
OTHER_CATEGORY = "OTHER"

# Syscalls flagged as network activity (narrower than the category).
NETWORK_EVENT_SYSCALLS = (
    "connect", "accept", "accept4", "bind", "listen", "sendto", "recvfrom", "sendmsg",
    "recvmsg", "socket",
)

# Syscalls flagged as privileged (narrower than SECURITY).
PRIVILEGED_SYSCALLS = (
    "ptrace", "mount", "umount2", "chroot", "bpf", "perf_event_open", "seccomp", "capset",
)

# x86-64 syscall numbers.
SYSCALL_NUMBERS = {
    0: "read", 1: "write", 2: "open", 3: "close", 4: "stat", 5: "fstat", 6: "lstat",
    7: "poll", 8: "lseek", 9: "mmap", 10: "mprotect", 11: "munmap", 12: "brk", 14: "ioctl",
    17: "pread64", 18: "pwrite64", 19: "readv", 20: "writev", 21: "access", 22: "pipe",
    23: "select", 32: "dup", 33: "dup2", 39: "getpid", 41: "socket", 42: "connect",
    43: "accept", 44: "sendto", 45: "recvfrom", 46: "sendmsg", 47: "recvmsg",
    48: "shutdown", 49: "bind", 50: "listen", 51: "getsockname", 52: "getpeername",
    56: "clone", 57: "fork", 58: "vfork", 59: "execve", 60: "exit", 61: "wait4",
    62: "kill", 72: "fcntl", 78: "getdents", 80: "chdir", 82: "rename", 83: "mkdir",
    84: "rmdir", 85: "creat", 87: "unlink", 90: "chmod", 92: "chown", 101: "ptrace",
    160: "setrlimit", 165: "mount", 166: "umount2", 167: "swapon", 200: "tkill",
    231: "exit_group", 257: "openat", 262: "newfstatat", 288: "accept4",
    302: "prlimit64", 317: "seccomp", 321: "bpf", 322: "execveat", 435: "clone3",
}

# IP protocol numbers with a name.
PROTOCOL_NAMES = {6: "TCP", 17: "UDP"}

# Anomaly decision, severity tiers (highest first) and their rank.
ANOMALY_THRESHOLD = 0.5
SEVERITY_TIERS = (("CRITICAL", 0.9), ("HIGH", 0.75), ("MEDIUM", 0.6), ("LOW", 0.5))
NO_SEVERITY = "NONE"
SEVERITY_RANK = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
ALERTING_SEVERITIES = ("HIGH", "CRITICAL")

# Risk level of a profile: (level, max score, anomaly rate).
RISK_LEVELS = (("CRITICAL", 0.9, 0.3), ("HIGH", 0.75, 0.15), ("MEDIUM", 0.6, 0.05))
LOWEST_RISK = "LOW"

# Isolation forest and training defaults.
TREE_COUNT = 200
SUBSAMPLE_SIZE = 1024
FOREST_SEED = 42
CONTAMINATION = 0.05
MIN_TRAINING_ROWS = 100
STD_FLOOR = 1e-8
VARIANCE_FLOOR = 1e-8
TOP_FEATURES = 5

# Windowing.
WINDOW_SECONDS = 30
LATENESS_SECONDS = 10
MAX_WINDOW_EVENTS = 10_000
MULTI_RESOLUTION_SECONDS = (30, 300, 900)

# Days each table is kept.
RETENTION_DAYS = {
    "runtime_events": 7,
    "processed_events": 7,
    "feature_vectors": 3,
    "anomaly_results": 14,
    "dead_letter": 30,
}

# Stream topics and the dead-letter suffix.
RUNTIME_EVENTS_TOPIC = "runtime-events"
PROCESSED_EVENTS_TOPIC = "processed-events"
FEATURE_VECTORS_TOPIC = "feature-vectors"
ANOMALY_RESULTS_TOPIC = "anomaly-results"
DEAD_LETTER_SUFFIX = ".DLT"
UNKNOWN_KEY = "unknown"
HOST_CONTAINER = "host"
NO_MODEL_VERSION = "none"

# Texts of descriptions, alerts and rejections.
NORMAL_DESCRIPTION = "Normal behavior observed"
ANOMALOUS_DESCRIPTION = "Anomalous behavior detected (score: %.3f)"
CONTRIBUTORS = "Top contributing features: "
WINDOW_EVENTS = "Window contained %d events"
ALERT_TITLE = "[%s] Anomaly detected on container %s"
ALERT_DESCRIPTION = "score=%.4f severity=%s resultId=%s"
UNKNOWN_SEVERITY = "UNKNOWN"
NO_CONTAINER = "container_id is required"
NO_SYSCALL = "syscall is required"
