"""One class per kind of failure; ``kind`` is what error columns carry."""


class EngineFailure(Exception):
    kind = "engine"


class RequestBuildError(EngineFailure):
    kind = "request_build"


class DownloadError(EngineFailure):
    kind = "download"


class ParseError(EngineFailure):
    kind = "parse"


class RulesError(EngineFailure):
    kind = "rules"


class PluginError(EngineFailure):
    kind = "plugin"


class SchedulerError(EngineFailure):
    kind = "scheduler"
