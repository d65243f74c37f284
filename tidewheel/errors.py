"""Errors of the query surface, each with its numeric code."""


class EngineError(Exception):
    """Base of the engine's errors; ``code`` is what a response carries."""

    code = 6
    message = "Fail To Execute Query"

    def __init__(self, detail: str = ""):
        super().__init__(f"{self.message}: {detail}" if detail else self.message)


# The codes and messages that clients know.

class MissingTable(EngineError):
    code, message = 1, "Table Not Set"


class MissingTimeRange(EngineError):
    code, message = 2, "Time Range Not Set"


class MissingOutputFields(EngineError):
    code, message = 3, "No Dimension Or Metric Set"


class FailBuildQuery(EngineError):
    code, message = 4, "Fail To Build Query"


class FailCompileQuery(EngineError):
    code, message = 5, "Fail To Compile Query Plan"


class FailExecuteQuery(EngineError):
    code, message = 6, "Fail To Execute Query"


class AuthRequired(EngineError):
    code, message = 7, "User Authentication Required To Execute"


class PermissionRequired(EngineError):
    code, message = 8, "User Has No Permission To Execute"


class TableNotFound(EngineError):
    code, message = 9, "Table in query not found"
