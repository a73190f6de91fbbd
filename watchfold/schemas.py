"""Schema of a pushed chat message."""

MESSAGE = (
    "name STRING, createTime STRING, "
    "sender STRUCT<name: STRING, email: STRING, displayName: STRING, type: STRING>, "
    "text STRING, argumentText STRING, "
    "attachment ARRAY<STRUCT<name: STRING, contentType: STRING, attachmentDataRef: STRUCT<resourceName: STRING>>>, "
    "_space_members ARRAY<STRUCT<email: STRING, displayName: STRING, type: STRING>>"
)
