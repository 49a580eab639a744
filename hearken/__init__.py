"""hearken: a PySpark-native engine for conversation-risk analytics and text-corpus preparation."""
