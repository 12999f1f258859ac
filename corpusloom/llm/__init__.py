"""Operations of a training-data pipeline at corpus scale. Nothing else in the library imports this subpackage."""
