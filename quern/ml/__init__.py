"""Machine learning: estimators fit by aggregates, models that are column expressions."""

from quern.ml.base import Estimator, Model, Params, Transformer  # noqa: F401
from quern.ml.classification import LogisticRegression, LogisticRegressionModel  # noqa: F401
from quern.ml.ensemble import (  # noqa: F401
    AutoMLClassifier,
    AutoMLRegressor,
    GBTClassifier,
    GBTRegressor,
    RandomForestClassifier,
    RandomForestRegressor,
)
from quern.ml.evaluation import (  # noqa: F401
    BinaryClassificationEvaluator,
    BinaryClassificationSummary,
    RegressionEvaluator,
    RegressionSummary,
)
from quern.ml.feature import (  # noqa: F401
    Binarizer,
    Imputer,
    IndexToString,
    MaxAbsScaler,
    MinMaxScaler,
    OneHotEncoder,
    QuantileDiscretizer,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from quern.ml.neighbors import KNeighborsClassifier, KNeighborsRegressor  # noqa: F401
from quern.ml.pipeline import Pipeline, PipelineModel  # noqa: F401
from quern.ml.regression import LinearRegression, LinearRegressionModel  # noqa: F401
from quern.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit  # noqa: F401
